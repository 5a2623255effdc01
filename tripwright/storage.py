"""Where intermediate tables go: the shared folder the cluster names, never a guess."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where none is set, a local master gets a fresh local
    folder; any other would lose what executors write to their own disks and is refused."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    context_dir = spark.sparkContext.getCheckpointDir()
    if context_dir:
        return context_dir.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(local)
    return local


def fresh_path(spark: SparkSession, stem: str) -> str:
    return f"{shared_dir(spark)}/tripwright/{stem}-{uuid.uuid4().hex}"


# Folders written by each application's ``materialize`` calls, until ``clean_up``.
_WRITTEN: dict[str, list[str]] = {}


def clean_up(spark: SparkSession) -> int:
    """Remove what this application materialized and say how many folders that were.

    For the owner of the results, once they are stored: frames built on them can't be read
    any more.
    """
    context = spark.sparkContext
    folders = _WRITTEN.pop(context.applicationId, [])
    for folder in folders:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    return len(folders)


def materialize(df: DataFrame, stem: str) -> DataFrame:
    """Write once and read back: results that several branches must see identically."""
    path = fresh_path(df.sparkSession, stem)
    _WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# How a plan treats an aggregate it uses several times: write it once, or leave it lazy.
Settle = Callable[[DataFrame, str], DataFrame]


def unsettled(df: DataFrame, stem: str) -> DataFrame:
    return df
