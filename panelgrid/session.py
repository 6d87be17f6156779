"""Session helpers: local sessions for tests/bench, shared scratch folder,
size-checked broadcast of dimension tables."""

from __future__ import annotations

import os
import tempfile
import uuid
from typing import Optional

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "panelgrid") -> SparkSession:
    """A local session configured like the tests and the bench expect."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        # a stack trace for every column expression makes large plans slow to build
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("PANELGRID_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for cut lineage / written tables.

    On a cluster it comes from the session (``spark.checkpoint.dir``) and is
    never replaced; only when it is unset (local tests) a fresh folder is made.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if cur:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(cur)
        return sc.getCheckpointDir() or cur
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="panelgrid-ckpt-")
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir() or path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


_SCRATCH: list[tuple[str, str]] = []


def passing_path(spark: SparkSession, name: str) -> str:
    """A scratch path that ``release_kept`` deletes: for files that a result reads lazily."""
    path = scratch_path(spark, name)
    _SCRATCH.append((spark.sparkContext.applicationId, path))
    return path


_KEPT: list[tuple[str, DataFrame]] = []
#: Frames kept at a time; an older one that is let go is computed anew where it is still read.
MOST_KEPT = 8


def kept(df: DataFrame) -> DataFrame:
    """``df``, kept by Spark (memory, then disk) once something reads it.

    For intermediates that several branches of one plan read: nothing runs now,
    and a lost executor's part is computed again from its lineage.  The oldest
    frame goes when there are more than MOST_KEPT, all go with ``release_kept``.
    """
    _KEPT.append((df.sparkSession.sparkContext.applicationId, df.persist(StorageLevel.MEMORY_AND_DISK)))
    while len(_KEPT) > MOST_KEPT:
        _let_go(_KEPT.pop(0), df.sparkSession)
    return df


def _let_go(entry: tuple[str, DataFrame], spark: SparkSession) -> None:
    app, df = entry
    if app == spark.sparkContext.applicationId:  # that of a stopped session is gone already
        df.unpersist()


def release_kept(spark: SparkSession) -> None:
    """Let go of all kept frames and delete the session's passing files."""
    while _KEPT:
        _let_go(_KEPT.pop(), spark)
    while _SCRATCH:
        app, path = _SCRATCH.pop()
        if app == spark.sparkContext.applicationId:
            delete_path(spark, path)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def rows_df(spark: SparkSession, rows, schema: str | StructType) -> DataFrame:
    """Rule table from python rows as a local (JVM-side) table.

    The rows travel once as an Arrow batch and become a ``LocalTableScan``;
    no Python worker is involved when the table is read.  ``schema`` is a DDL
    string such as ``"a string, b bigint"``.  A DataFrame passes through.
    """
    if isinstance(rows, DataFrame):
        return rows
    import pandas as pd

    if isinstance(schema, StructType):
        names = [f.name for f in schema.fields]
    else:
        names = [part.strip().split(None, 1)[0] for part in schema.split(",")]
    pdf = pd.DataFrame(list(rows), columns=names)
    return spark.createDataFrame(pdf, schema)


def bounded_broadcast(df: DataFrame, max_rows: int, known_rows: Optional[int] = None) -> DataFrame:
    """Broadcast ``df`` only when its length is known and at most ``max_rows``.

    Python rule tables pass their length.  Of a DataFrame nothing is known
    while the plan is built: it is returned as it is, and Spark decides by the
    size it meets at run time.
    """
    return F.broadcast(df) if known_rows is not None and known_rows <= max_rows else df


def rule_dim(spark: SparkSession, rows, schema: str, max_rows: int) -> DataFrame:
    """Rule table as a (size-checked) broadcastable dimension."""
    if isinstance(rows, DataFrame):
        return bounded_broadcast(rows, max_rows)
    rows = list(rows)
    return bounded_broadcast(rows_df(spark, rows, schema), max_rows, known_rows=len(rows))
