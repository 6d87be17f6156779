"""Long export of a grid.

The grid is already long (one row per construct × target with value and
status), so the value/status "melt + merge" of a wide matrix is a projection
here.  Rows carry ``export_seq`` = column-major position (column order, then
reference row order) and are written range-partitioned on it, so the files
concatenate in export order without a single-task sort.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.sheets import write_sheet

C, T = "Construct_Description", "PSV"


def export_long(grid: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, Construct_Description, PSV, value, status, export_seq)."""
    seq = (F.col("col_rank") - 1) * F.col("n_rows") + F.col("export_rank")
    return grid.select(*keys, C, T, "value", "status", seq.cast("bigint").alias("export_seq"))


def write_export(export: DataFrame, path: str, fmt: str = "csv", keys: Sequence[str] = ()) -> None:
    """Write the export sorted by ``export_seq`` (range partitioned; part files
    are in order).  CSV uses the quote/escape dialect that keeps newlines."""
    n = int(export.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = export.repartitionByRange(n, *keys, "export_seq").sortWithinPartitions(*keys, "export_seq")
    if fmt == "csv":
        write_sheet(ordered, path)
    else:
        ordered.write.mode("overwrite").format(fmt).save(path)
