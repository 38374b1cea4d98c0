"""Intermediate tables in the folder that all executors share.

The cluster names that folder in ``spark.checkpoint.dir``; only where it is unset (tests, a laptop) a temporary one is
made and set on the context.  A table written here cuts the lineage: a lost executor costs no recomputation of it.  So the
shuffle files that it was made from go as soon as it is there.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from .. import store


def shared_dir(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="srclake-")
        spark.sparkContext.setCheckpointDir(found)
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


_made: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("made", default=None)


@contextlib.contextmanager
def temporary(spark: SparkSession):
    """Tables that are saved within are deleted at the end, but for those saved with kept=True."""
    made: list[str] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        drop(spark, *made)


def save(df: DataFrame, tag: str, codec: str = "zstd", by: str | None = None, kept: bool = False) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder, in a folder for each value of `by`; the table read back, and its path."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm-{tag}-{uuid.uuid4().hex}"
    if not kept and _made.get() is not None:
        _made.get().append(path)
    out = df.write.option("compression", codec)
    with store.shuffles_dropped(spark):
        (out.partitionBy(by) if by else out).parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def append(df: DataFrame, tag: str, path: str | None) -> str:
    """Write df's rows to the table at path, a new one if there is none; its path."""
    path = path or f"{shared_dir(df.sparkSession)}/llm-{tag}-{uuid.uuid4().hex}"
    df.write.mode("append").parquet(path)
    return path


def saved(df: DataFrame, tag: str, codec: str = "zstd") -> DataFrame:
    return save(df, tag, codec)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Delete tables that no plan reads any more."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    for path in paths:
        p = hadoop.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of df's size in bytes, from file sizes; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
