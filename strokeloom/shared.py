"""The folder that driver and executors share, and small file operations there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def file_system(spark: SparkSession, path: str):
    """(file system, path) of the JVM for any path that Spark can read."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(context._jsc.hadoopConfiguration()), at


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local session may go without it; it then gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='strokeloom-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    forget(spark, own)
    return own


def forget(spark: SparkSession, path: str) -> None:
    """The path is deleted when the driver's JVM ends."""
    fs, at = file_system(spark, path)
    fs.deleteOnExit(at)


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, gone with the driver."""
    path = f"{shared_dir(spark)}/strokeloom/{name}-{uuid.uuid4().hex}"
    forget(spark, path)
    return path
