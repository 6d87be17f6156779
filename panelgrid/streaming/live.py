"""Live views: newly landed sheet files update the cell aggregates.

The dashboard re-reads a "live" sheet; the Spark counterpart is a stream of
sheet files whose rows are prepared exactly like a batch sheet (stream-static
joins against the same broadcast rule dimensions) and folded into decomposable
per-cell aggregates kept in the state store.  ``view_from_cells`` turns the
aggregates into the view table that ``build_grid`` consumes.
"""

from __future__ import annotations

from typing import Optional

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import Rules
from ..functions.arrays import value_at_dose
from ..operators.prepare import prepare
from ..operators.view import VIEW_KEYS
from ..sources.sheets import CSV_OPTIONS


def sheet_stream(spark: SparkSession, directory: str, columns: list[str],
                 max_files_per_trigger: Optional[int] = None) -> DataFrame:
    """All-text stream of CSV sheets landing in ``directory``."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    r = spark.readStream.options(**CSV_OPTIONS).schema(schema)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", str(max_files_per_trigger))
    return r.csv(directory).na.fill("")


def cell_aggregates(raw: DataFrame, rules: Rules, dilution: float,
                    constructs: Optional[DataFrame] = None) -> DataFrame:
    """Per (bucket, construct, target): sums and counts for the % metric at
    ``dilution`` and for the log10 metric (streaming or batch input)."""
    tidy = prepare(raw, rules, constructs).tidy
    d = tidy.filter(F.col("Bucket_Type").isin(*rules.buckets))
    cv = value_at_dose("DilutionArray", "NeutArray", float(dilution))
    return d.groupBy(*VIEW_KEYS).agg(
        F.sum(cv).alias("pct_sum"), F.count(cv).alias("pct_n"),
        F.count(F.lit(1)).alias("rows_n"), F.sum(F.col("Is_NN").cast("long")).alias("nn_n"),
        F.sum("Log10_IC50").alias("log_sum"), F.count("Log10_IC50").alias("log_n"))


def start_live_cells(raw_stream: DataFrame, rules: Rules, dilution: float, table_path: str,
                     checkpoint: str, constructs: Optional[DataFrame] = None, available_now: bool = True):
    """Run the stateful aggregation; every micro-batch adds the cells that it
    changed to the table at ``table_path``, in a folder of its own, so readers
    never meet a half-written table and a repeated batch replaces itself.
    Returns the StreamingQuery."""
    cells = cell_aggregates(raw_stream, rules, dilution, constructs)

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{table_path}/batch={epoch}")

    w = (cells.writeStream.outputMode("update").foreachBatch(write)
         .option("checkpointLocation", checkpoint))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")
    return w.start()


def view_from_cells(cells: DataFrame, metric: str) -> DataFrame:
    """The view (A1 / A3 semantics) from the cell aggregates; of a live table,
    each cell's latest batch."""
    if "batch" in cells.columns:
        sums = [c for c in cells.columns if c not in (*VIEW_KEYS, "batch")]
        cells = cells.groupBy(*VIEW_KEYS).agg(F.max_by(F.struct(*sums), "batch").alias("_last")).select(*VIEW_KEYS, "_last.*")
    if metric == "pct_neut":
        return cells.filter(F.col("pct_n") > 0).select(
            *VIEW_KEYS, (F.col("pct_sum") / F.col("pct_n")).alias("value"),
            F.col("pct_n").alias("n_tested"), F.lit(False).alias("all_nn"))
    all_nn = F.col("nn_n") == F.col("rows_n")
    mean = F.when(F.col("log_n") > 0, F.col("log_sum") / F.col("log_n"))
    return cells.select(*VIEW_KEYS, F.when(~all_nn, mean).alias("value"),
                        F.col("rows_n").alias("n_tested"), all_nn.alias("all_nn"))
