"""Stored tables that notice change.

What was derived from input files is kept as a versioned table in the shared
folder, beside a manifest of what it was made from: every input file's path,
length and modification time, and a hash of the rules.  A later request lists the
inputs again (metadata alone) and reads the stored version if the manifest is the
same, else makes a new one.  Plans on top start at a table scan, so they stay
small however long the preparation was, and any executor can read them.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import delete_path, ensure_checkpoint_dir

#: Beyond so many files the listing is hashed by a Spark job instead of one by one on the driver.
LISTED = 2_000


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def listing_hash(spark: SparkSession, paths: Sequence[str]) -> str:
    """A hash of every file's path, length and modification time under ``paths``; missing ones count as such."""
    seen = hashlib.sha256()
    for path in sorted(paths):
        at, fs = _file_system(spark, path)
        if not fs.exists(at):
            seen.update(f"{path} missing".encode())
            continue
        if fs.getContentSummary(at).getFileCount() > LISTED:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
            h = F.xxhash64("path", "length", "modificationTime")
            seen.update(repr(tuple(files.agg(F.count("*"), F.sum("length"), F.bit_xor(h), F.sum(h.cast("decimal(20,0)"))).first())).encode())
            continue
        found, files = [], fs.listFiles(at, True)
        while files.hasNext():
            f = files.next()
            found.append(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}")
        seen.update("\n".join(sorted(found)).encode())
    return seen.hexdigest()


def rules_hash(rules) -> str:
    """A hash of rule tables: python values by their text, DataFrames by the hash of their plan."""
    values = {k: v.semanticHash() if isinstance(v, DataFrame) else repr(v) for k, v in sorted(vars(rules).items())}
    return hashlib.sha256(json.dumps(values, sort_keys=True).encode()).hexdigest()


class TableStore:
    """Versions of named groups of tables under a root in the shared folder."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark = spark
        self.root = (root or f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables").rstrip("/")

    def _folder(self, name: str, manifest: Mapping[str, str]) -> str:
        version = hashlib.sha256(json.dumps(dict(manifest), sort_keys=True).encode()).hexdigest()[:16]
        return f"{self.root}/{name}/{version}"

    def has(self, name: str, manifest: Mapping[str, str]) -> bool:
        """Whether that version is whole: its manifest is written last."""
        at, fs = _file_system(self.spark, f"{self._folder(name, manifest)}/manifest/_SUCCESS")
        return bool(fs.exists(at))

    def fetch(self, name: str, manifest: Mapping[str, str], makers: Mapping[str, Callable[[dict[str, DataFrame]], DataFrame]]) -> dict[str, DataFrame]:
        """The tables of ``makers`` (in order; each may read those before it), made only where this version isn't stored."""
        folder, out = self._folder(name, manifest), {}
        whole = self.has(name, manifest)
        for table, make in makers.items():
            if not whole:
                make(out).write.mode("overwrite").parquet(f"{folder}/{table}")
            out[table] = self.spark.read.parquet(f"{folder}/{table}")
        if not whole:
            text = self.spark.range(1).select(F.lit(json.dumps(dict(manifest), sort_keys=True)).alias("value"))
            text.coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")
        return out

    def clear(self, name: str | None = None) -> None:
        """Delete all versions of ``name``, or of everything stored here."""
        delete_path(self.spark, f"{self.root}/{name}" if name else self.root)
