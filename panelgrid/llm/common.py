"""Helpers shared by the operators of this subpackage: stored intermediates in
the cluster's shared folder, table reading, learning folds."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelgrid.session import scratch_path


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet under ``spark.checkpoint.dir`` and read back.

    Cuts the lineage with a table that every executor can read; losing an
    executor afterwards loses nothing.
    """
    return stored_at(df, name)[0]


def stored_at(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with writing(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


#: Spark's own settings for the writing of intermediate tables: a query's shuffle files
#: go when it ends, not when the driver next collects its garbage (a plan that is run
#: again makes them anew), and a join whose smaller side turns out to have no partition
#: over this size is hashed instead of sorted.
_WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Queries run inside leave no shuffle files behind; what they read and write stays."""
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    for k, v in _WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table written by :func:`stored_at` that nothing reads any more."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """crc32 of the id's text, modulo 3, is 1; a null id counts as held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(True))


def one_row_per_input(df: DataFrame, columns: list[str]) -> DataFrame:
    """Only ``columns`` of ``df``, missing ones as nulls, so that extra columns
    can neither clash with an operator's own names nor be read from disk."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(None).alias(c) for c in columns])
