"""Intermediate tables: written once to the cluster's shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


_workspace: ContextVar[str | None] = ContextVar("workspace", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``.

    Where it is unset a local session (tests) gets a temporary folder; on a cluster that is an error, as
    each node would write to its own disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shoal-", dir="/tmp")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{_workspace.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def workspace(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` and ``kept`` make inside are removed at the end; results are written elsewhere before."""
    path = fresh_path(spark, "work")
    token = _workspace.set(path)
    try:
        yield
    finally:
        _workspace.reset(token)
        drop(spark, path)


def written(df: DataFrame, name: str, compression: str = "zstd") -> tuple[DataFrame, str]:
    """Write ``df`` once to the shared folder and read it back: cuts lineage and survives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def kept(df: DataFrame, name: str = "step") -> DataFrame:
    return written(df, name)[0]


def drop(spark: SparkSession, *paths: str) -> None:
    """Remove tables that ``written`` made, through the file system that holds them."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
