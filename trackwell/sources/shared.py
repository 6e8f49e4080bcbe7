"""Intermediate results in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session (tests) gets a
    temporary folder, and a cluster an error, because its executors couldn't see the driver's own folders."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.trackwell.scratch", None)
    if not named:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="trackwell-")
        spark.conf.set("spark.trackwell.scratch", named)
    return named.rstrip("/")


def scratch(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: a lineage cut that survives lost executors.

    The files go when the driver's JVM ends, or by discard()."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where, files = place(spark, path)
    files.deleteOnExit(where)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def place(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(df: DataFrame | None) -> None:
    """Delete what scratch() wrote for df; nothing may read it any more."""
    if df is not None and getattr(df, "_scratch", None):
        where, files = place(df.sparkSession, df._scratch)
        files.delete(where, True)
