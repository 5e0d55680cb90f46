"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table, never by a local checkpoint, so that a lost executor loses nothing.
The folder is the cluster's ``spark.checkpoint.dir``; only where that is unset (tests, a single machine)
a folder of the session's own is taken and set.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """URI of the shared folder, without a trailing slash."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    conf = conf or spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        own = tempfile.mkdtemp(prefix="echofold-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        conf = "file://" + own
        spark.conf.set("spark.checkpoint.dir", conf)
    return conf.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, in a folder of the application's own."""
    return f"{_own(spark)}/{name}-{uuid.uuid4().hex}"


def _own(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/echofold/{spark.sparkContext.applicationId}"


def clear(spark: SparkSession) -> None:
    """Delete what this application has written there; nothing derived from it can be read afterwards."""
    drop_path(spark, _own(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut lineage that survives executor loss."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = 10_000) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows (counted, no further than that), else as it is: the join is
    then a shuffle join. For tables whose size follows from the data's shape, not from its volume."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` over at least as many partitions as the cluster has cores: for work that costs far more per row than moving it, on
    input that came as a few files. Input of more partitions stays as it is, and so does the outcome of a shuffle, whose
    partitions aren't known before it has run."""
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a path on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
