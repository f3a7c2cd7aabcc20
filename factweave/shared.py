"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder, `spark.checkpoint.dir`.

    Only where everything runs in one process, as in tests, may the session leave it unset: a temporary folder serves then.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared-")
        context.setCheckpointDir(base)
    return f"{base.rstrip('/')}/scratch-{context.applicationId}"


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"


def settled(df: DataFrame, tag: str = "round") -> DataFrame:
    """The rows written to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, tag)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _hadoop(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = _hadoop(spark, path)
    fs.delete(where, True)


def clear(spark: SparkSession) -> None:
    """Delete this application's scratch tables. DataFrames that read them must be written before."""
    remove(spark, shared_dir(spark))


def read_small(spark: SparkSession, path: str) -> str | None:
    """A small file's text wherever Spark can read, or None."""
    fs, where = _hadoop(spark, path)
    return spark.read.text(path, wholetext=True).first()[0] if fs.exists(where) else None


def write_small(spark: SparkSession, path: str, text: str) -> None:
    fs, where = _hadoop(spark, path)
    out = fs.create(where, True)
    out.write(bytearray(text.encode()))
    out.close()
