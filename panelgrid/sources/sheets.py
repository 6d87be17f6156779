"""Measurement-sheet sources (S1-S3, S5, S6, S7 writer options).

A sheet is text: every column is read as a string (no schema inference),
ragged rows are padded with ``""`` and header names are stripped.  Column
roles are then resolved from the header names with ordered patterns; that is
plan-time work over the schema only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Iterable, Mapping, Optional, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..config import CONSTRUCT_HEADER_PATTERNS, sheet_roles
from ..operators.ranking import ordered_rank
from ..session import bounded_broadcast

# CSV dialect that round-trips quotes.
CSV_OPTIONS = {"header": "true", "quote": '"', "escape": '"',
               "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


#: File lists of up to this many rows are broadcast to the rows of the files.
MAX_LISTED = 200_000


@dataclass(frozen=True)
class SheetScan:
    """Sheets as read: the ``rows`` that fit the header, and ``rejects``, one row
    for each that has more cells (file, split_start, row_in_split from 1, cells
    up to the first one beyond the header)."""

    rows: DataFrame
    rejects: DataFrame


def list_sheets(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """The files under ``paths`` from metadata alone: (nth, file, n_bytes), a file
    that several paths name at the first of them.  One listing for each path, so
    that many files are best named by a folder or a pattern."""
    found = None
    for k, p in enumerate(paths):
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(p).select(
            F.lit(k).alias("nth"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("n_bytes"))
        found = files if found is None else found.unionByName(files)
    return found.groupBy("file").agg(F.min("nth").alias("nth"), F.max("n_bytes").alias("n_bytes")).select("nth", "file", "n_bytes")


def scan_sheets(spark: SparkSession, path: str | Sequence[str], row_id: str = "row_id",
                multi_line: bool = False, refuse: bool = False) -> SheetScan:
    """CSV sheet(s) from any Hadoop-FS URI as all-text columns.

    Short rows are padded with ``""`` and header names are stripped; rows with
    more cells than the header are told apart, or with ``refuse`` fail the read.  Folders are read with the folders
    in them.  ``multi_line`` admits line ends inside cells; each file is then one
    split.

    ``row_id`` grows with the place of the file in ``path`` (files of a folder:
    by name), the split's place in the file and the row's place in the split,
    whatever order Spark reads them in.  Every file is parsed once: places come
    from :func:`list_sheets`, joined on the file's exact URI.
    """
    paths = list(dict.fromkeys([path] if isinstance(path, str) else path))
    reader = (spark.read.options(**CSV_OPTIONS).option("inferSchema", "false").option("multiLine", multi_line)
              .option("recursiveFileLookup", "true"))
    names = reader.csv(paths).columns
    schema = StructType([StructField(c, StringType()) for c in [*names, "_beyond"]])
    read = reader.option("enforceSchema", "true").schema(schema).csv(paths)
    meta, in_split = F.col("_metadata"), F.col("_row").bitwiseAND(F.lit((1 << 33) - 1))  # above these bits is the task
    df = read.select("*", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_split"),
                     F.monotonically_increasing_id().alias("_row"))
    rejects = df.where(F.col("_beyond").isNotNull()).select(
        F.col("_file").alias("file"), F.col("_split").alias("split_start"), (in_split + 1).alias("row_in_split"),
        F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in [*names, "_beyond"]]).alias("cells"))
    longer = F.concat(F.lit("more cells than header names in "), F.col("_file"), F.lit(": "), F.col("_beyond"))
    fits = F.col("_beyond").isNull()
    rows = df.where(F.when(fits, F.lit(True)).otherwise(F.raise_error(longer).cast("boolean")) if refuse else fits)
    stripped = [c.strip() for c in names]
    cells = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(s) for c, s in zip(names, stripped)]
    if not row_id or row_id in stripped:
        return SheetScan(rows.select(*cells), rejects)
    numbered = ordered_rank(list_sheets(spark, paths), [], [F.col("nth"), F.col("file")], rank_col="_of")
    placed = rows.join(bounded_broadcast(numbered.select(F.col("file").alias("_file"), "_of"), MAX_LISTED, len(read.inputFiles())), "_file")
    order = F.concat(*[F.lpad(c.cast("string"), width, "0") for c, width in ((F.col("_of"), 7), (F.col("_split"), 15), (in_split, 10))])
    return SheetScan(placed.select(*cells, order.cast("decimal(38,0)").alias(row_id)), rejects)


def read_sheet(spark: SparkSession, path: str | Sequence[str], row_id: str = "row_id",
               multi_line: bool = False) -> DataFrame:
    """The rows of :func:`scan_sheets`; reading fails at a row with more cells than the header."""
    return scan_sheets(spark, path, row_id, multi_line, refuse=True).rows


def write_sheet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a sheet as CSV with the same dialect (used by exports and tests)."""
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def match_headers(headers: Sequence[str], roles: Mapping[str, Sequence[str]]) -> dict[str, Optional[str]]:
    """The header of each role.  Every (pattern, header) hit of a role is a
    candidate; the best is that of the earliest pattern, then the leftmost."""
    best = {}
    for role, patterns in roles.items():
        hits = ((rank, place) for rank, p in enumerate(patterns) for place, h in enumerate(headers)
                if re.search(p, h, re.IGNORECASE))
        _, place = min(hits, default=(None, None))
        best[role] = None if place is None else headers[place]
    return best


@dataclass(frozen=True)
class SheetColumns:
    """Resolved column names of a measurement sheet (None = absent)."""

    sample: Optional[str]
    group: Optional[str]
    psvx: Optional[str]
    psv: Optional[str]
    day: Optional[str]
    experiment: Optional[str]
    desc: Optional[str]
    dilution: Optional[str]
    neut: Optional[str]
    ic50: Optional[str]

    def as_dict(self) -> dict:
        return dict(sample=self.sample, group=self.group, psvx=self.psvx, psv=self.psv,
                    day=self.day, experiment=self.experiment, desc=self.desc,
                    dilution=self.dilution, neut=self.neut, ic50=self.ic50)


def _headers(columns: Iterable[str]) -> list[str]:
    return [str(c).strip() for c in columns if c != "row_id"]


def resolve_columns(columns: Iterable[str], corrected: bool = True) -> SheetColumns:
    """S5 + S6: the header of every role, measurements corrected or raw."""
    return SheetColumns(**match_headers(_headers(columns), sheet_roles(corrected)))


def resolve_construct_columns(columns: Iterable[str]) -> dict:
    return match_headers(_headers(columns), CONSTRUCT_HEADER_PATTERNS)


def select_resolved(raw: DataFrame, corrected: bool = True) -> DataFrame:
    """Project a sheet onto role names (absent roles become ``""``)."""
    cols = resolve_columns(raw.columns, corrected)
    out = [F.col("row_id")] if "row_id" in raw.columns else []
    for role, name in cols.as_dict().items():
        out.append((F.col(f"`{name}`") if name else F.lit("")).cast("string").alias(role))
    return raw.select(*out)
