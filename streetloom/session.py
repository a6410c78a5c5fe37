"""Session helpers: the shared folder, staged tables, table reading."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share (spark.checkpoint.dir). Where none is set, as in tests, a local one, on a local
    master only: a machine's own folder would not be seen by the other executors of a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="streetloom-")
        atexit.register(shutil.rmtree, _OWN["dir"], ignore_errors=True)
    return "file://" + _OWN["dir"]


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in this application's folder, which is deleted when the application ends."""
    run = f"{shared_dir(spark)}/streetloom-{spark.sparkContext.applicationId}"
    if run not in _OWN:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(run)
        fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        fs.mkdirs(p)
        fs.deleteOnExit(p)
        _OWN[run] = run
    return f"{run}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged folder on whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: the lineage ends there, and a lost executor loses nothing.

    The folder stays until the application ends (the caller's lazy result still reads it)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path) if not partition_by else spark.read.parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df, a plain scan, in at least as many partitions as there are cores: a file of one row group is one partition,
    and work of milliseconds a row would run on one core. Larger tables have more and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or cores < 2 or sum(1 for _ in df.inputFiles()) >= cores:
        return df
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < 2 * cores else df
