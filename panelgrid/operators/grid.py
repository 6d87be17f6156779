"""Dense construct × target grid (C7): pooled cells (A4-A6), status (F11),
dense alignment (J7, U2), row / column breadth and mean (A7-A9), row and
column order (W1, W2, J12), pivot / unpivot (A15, A16), cell encoding (F14).

Plan shape (all inputs are the already aggregated view):

1. cells        groupBy(keys, construct, target): pooled mean, any-hit status
2. labels       breadth and mean of rows, breadth and genotype of columns, both
                ranked in one keyed ``ordered_rank``
3. columns are cut into blocks of about BLOCK by a hash of their name; the dense
   grid is each ranked row × the blocks of its view, where a block's cells of one
   construct are a map.  No row holds more than a block, however many targets a
   view has.

Cells and labels are read by several branches of the plan and are kept
(``session.kept``) while it runs; nothing runs while it is built.
"""

from __future__ import annotations

from typing import Optional, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import HIT, MISS, NN, NO_GENOTYPE, NOT_TESTED
from ..functions.exact import mean, sum_parts
from ..functions.status import cell_encoding, cell_label, cell_status
from ..session import kept, rows_df
from .ranking import ordered_rank

C, T = "Construct_Description", "PSV"
TESTED = (HIT, MISS, NN)
POSITIVE = (HIT, MISS)
#: Columns of the dense grid that one row is exploded to.
BLOCK = 512


def cell_statuses(view: DataFrame, metric, mode, threshold, ge) -> DataFrame:
    """F11 on every view row (threshold None → 0.0, ge None → True)."""
    thr = 0.0 if threshold is None else threshold
    g = True if ge is None else ge
    return view.withColumn("status", cell_status(F.col("value"), F.col("n_tested") > 0,
                                                 F.col("all_nn"), metric, mode, thr, g))


def pooled_cells(view: DataFrame, metric, mode, threshold, ge, bucket=None,
                 keys: Sequence[str] = ()) -> DataFrame:
    """F8 + A4-A6: one row per (keys, construct, target).

    value = mean of the bucket means; status = hit if any bucket is a hit,
    else the status of the alphabetically first bucket; n_tested = sum."""
    v = view
    if isinstance(bucket, Column):
        v = v.filter((bucket == "All") | (F.col("Bucket_Type") == bucket))
    elif bucket is not None and bucket != "All":
        v = v.filter(F.col("Bucket_Type") == bucket)
    v = cell_statuses(v, metric, mode, threshold, ge)
    return v.groupBy(*keys, C, T).agg(
        *sum_parts("value", "v"),
        F.when(F.max(F.col("status") == HIT), F.lit(HIT))
        .otherwise(F.min_by("status", "Bucket_Type")).alias("status"),
        F.sum("n_tested").alias("n_tested")).select(*keys, C, T, mean("v").alias("value"), "status", "n_tested")


def _breadth(n_pos: Column, n_tested: Column) -> Column:
    return F.when(n_tested > 0, F.try_divide(n_pos.cast("double"), n_tested.cast("double"))) \
        .otherwise(F.lit(0.0))


def with_genotype(targets: DataFrame, genotypes: Optional[dict]) -> DataFrame:
    """Target → genotype label, missing → 'zzz' (a join with the rule table)."""
    if not genotypes:
        return targets.withColumn("genotype", F.lit(NO_GENOTYPE))
    table = rows_df(targets.sparkSession, sorted(genotypes.items()), f"{T} string, _genotype string")
    return targets.join(table, T, "left").withColumn(
        "genotype", F.coalesce("_genotype", F.lit(NO_GENOTYPE))).drop("_genotype")


def ranked_labels(cells: DataFrame, keys: Sequence[str], sort_by, sort_descending,
                  genotypes: Optional[dict] = None, columns: bool = True, use_genotype=True) -> DataFrame:
    """W1 and W2 in one keyed step, each cell counted for its row and its column.

    Rows (kind 'row'): reference order is ascending by breadth or mean when
    ``sort_descending`` (the screen shows it reversed), descending otherwise; ties
    by name ascending.  Means are exact sums over a count, so equal ones tie in
    every evaluation.  Columns (kind 'column'): genotype, falling breadth, name."""
    st = F.col("status")
    labels = [F.struct(F.lit(kind).alias("kind"), F.col(c).alias("name")) for kind, c in (("row", C), ("column", T))[:2 if columns else 1]]
    marks = cells.select(*keys, "value", st.isin(*TESTED).alias("_t"), st.isin(*POSITIVE).alias("_p"), F.inline(F.array(*labels)))
    g = marks.groupBy("kind", *keys, "name").agg(
        F.count_if("_t").alias("n_tested_targets"), F.count_if("_p").alias("n_positive"), *sum_parts("value", "v"))
    g = g.select("kind", *keys, "name", "n_tested_targets", "n_positive",
                 _breadth(F.col("n_positive"), F.col("n_tested_targets")).alias("breadth"), F.coalesce(mean("v"), F.lit(0.0)).alias("mean"))
    is_row = F.col("kind") == "row"
    table = rows_df(cells.sparkSession, [("column", *x) for x in sorted((genotypes or {}).items())], "kind string, name string, _genotype string")
    if columns and genotypes:
        g = g.join(table, ["kind", "name"], "left")
    else:
        g = g.withColumn("_genotype", F.lit(None).cast("string"))
    as_col = lambda x: x if isinstance(x, Column) else F.lit(x)
    key = F.when(as_col(sort_by) == "breadth", F.col("breadth")).otherwise(F.col("mean"))
    key = F.when(as_col(sort_descending), key).otherwise(-key)
    genotype = F.coalesce(F.when(as_col(use_genotype), F.col("_genotype")), F.lit(NO_GENOTYPE))
    g = g.select("kind", *keys, "name", "n_tested_targets", "n_positive", "breadth", "mean",
                 F.when(~is_row, genotype).alias("genotype"), F.when(is_row, key).otherwise(-F.col("breadth")).alias("_key"))
    return ordered_rank(g, ["kind", *keys], [F.col("genotype"), F.col("_key"), F.col("name")], "rank", "size").drop("_key")


def build_grid(view: DataFrame, metric="log10_ic50", mode="none", threshold=None, ge=None,
               bucket=None, sort_by="breadth", sort_descending=True, genotypes: Optional[dict] = None,
               keys: Sequence[str] = (), dense: bool = True,
               target_order: Optional[DataFrame] = None, use_genotype=True) -> DataFrame:
    """Long grid, one row per (keys, construct, target).

    Columns: keys, Construct_Description, PSV, value, status, n_tested,
    row_breadth, row_mean, n_positive, n_tested_targets, export_rank (reference
    order), row_rank (1 = top of screen), n_rows, col_rank, col_breadth, genotype.

    Metric to sort_descending and use_genotype may be columns that follow from
    the keys, so that one plan holds grids of different requests.

    ``target_order`` (keys..., PSV, col_rank) replaces the computed column
    order and the column set (used to densify to a fixed panel, J8).
    """
    keys = list(keys)
    cells = kept(pooled_cells(view, metric, mode, threshold, ge, bucket, keys))
    labels = kept(ranked_labels(cells, keys, sort_by, sort_descending, genotypes, dense and target_order is None, use_genotype))
    ranked = labels.where("kind = 'row'").select(
        *keys, F.col("name").alias(C), F.col("breadth").alias("row_breadth"), F.col("mean").alias("row_mean"), "n_positive", "n_tested_targets",
        F.col("rank").alias("export_rank"), F.col("size").alias("n_rows"), (F.col("size") - F.col("rank") + 1).alias("row_rank"))
    if not dense:
        return cells.join(ranked, [*keys, C], "inner")

    if target_order is None:
        col_keys = keys
        columns = labels.where("kind = 'column'").select(
            *keys, F.col("name").alias(T), F.col("rank").alias("col_rank"), F.col("breadth").alias("col_breadth"), "genotype")
    else:
        # fixed column set and order (J8); the same for every view unless the
        # order table carries the view keys
        col_keys = [k for k in keys if k in target_order.columns]
        columns = with_genotype(target_order.select(*col_keys, T, "col_rank"), genotypes).withColumn(
            "col_breadth", F.lit(None).cast("double"))
    # A column's block follows from its name, so cells find theirs without a join.
    widest = columns.select(*col_keys, T) if target_order is not None else cells.select(*keys, T).distinct()
    widest = widest.groupBy(*col_keys).count().agg(F.max("count")).scalar()
    n_blocks = F.greatest(F.ceil(widest / F.lit(BLOCK)), F.lit(1)).cast("int")
    block = F.pmod(F.xxhash64(T), F.col("_blocks")).cast("int").alias("_block")
    item = F.struct(F.col("col_rank").alias("r"), F.col(T).alias("t"), F.col("col_breadth").alias("b"),
                    F.col("genotype").alias("g"))
    blocks = columns.withColumn("_blocks", n_blocks).withColumn("_block", block).groupBy(*col_keys, "_block").agg(
        F.collect_list(item).alias("_targets"))
    in_block = cells.withColumn("_blocks", n_blocks).withColumn("_block", block).groupBy(*keys, C, "_block").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(T), F.struct("value", "status", "n_tested")))).alias("_cells"))
    spread = ranked.withColumn("_blocks", n_blocks).withColumn("_block", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    rows = spread.join(blocks, [*col_keys, "_block"]).join(in_block, [*keys, C, "_block"], "left")
    exploded = rows.select("*", F.explode("_targets").alias("_tg")).drop("_targets")
    cell = F.try_element_at(F.col("_cells"), F.col("_tg")["t"])
    return exploded.select(
        *keys, C, F.col("_tg")["t"].alias(T),
        cell["value"].alias("value"),
        F.coalesce(cell["status"], F.lit(NOT_TESTED)).alias("status"),
        F.coalesce(cell["n_tested"], F.lit(0)).cast("bigint").alias("n_tested"),
        "row_breadth", "row_mean", "n_positive", "n_tested_targets",
        "export_rank", "row_rank", "n_rows",
        F.col("_tg")["r"].cast("bigint").alias("col_rank"),
        F.col("_tg")["b"].alias("col_breadth"), F.col("_tg")["g"].alias("genotype"))


def encode_cells(grid: DataFrame, metric, mode, show_values: bool = True) -> DataFrame:
    """the number and the text drawn in each cell."""
    return grid.withColumn("z", cell_encoding(F.col("value"), F.col("status"), metric, mode)) \
        .withColumn("label", cell_label(F.col("value"), F.col("status"), mode, show_values))


def pivot_wide(grid: DataFrame, value_col: str = "value", keys: Sequence[str] = (),
               targets: Optional[Sequence[str]] = None) -> DataFrame:
    """Long grid → wide matrix (one column per target, in column order).

    Its columns are part of the plan, so their names come to the driver first;
    ``targets`` saves that job where the caller knows them."""
    if targets is None:
        named = grid.groupBy(T).agg(F.min("col_rank").alias("r")).orderBy("r", T)
        targets = [r[T] for r in named.collect()]
    return (grid.groupBy(*keys, C, "export_rank").pivot(T, list(targets))
            .agg(F.first(value_col)))


def unpivot_long(wide: DataFrame, ids: Sequence[str], var_name: str = "PSV",
                 value_name: str = "value") -> DataFrame:
    """Wide matrix → long rows (all non-id columns)."""
    values = [c for c in wide.columns if c not in ids]
    return wide.unpivot(list(ids), values, var_name, value_name)
