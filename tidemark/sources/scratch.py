"""A folder for tables that a query writes and reads again, in what all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or where it is unset the context's checkpoint folder or the warehouse. A warehouse on local
    disks is refused unless all runs on one machine: executors elsewhere couldn't read what is written there."""
    sc = spark.sparkContext
    given = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if given:
        return given.rstrip("/")
    path = sc._jvm.org.apache.hadoop.fs.Path(spark.conf.get("spark.sql.warehouse.dir"))
    if not sc.master.startswith("local") and path.getFileSystem(sc._jsc.hadoopConfiguration()).getScheme() == "file":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return path.toString().rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A new one below root(), deleted when the application ends."""
    sc = spark.sparkContext
    path = f"{root(spark)}/{name}-{uuid.uuid4().hex}"
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written once and read back, where several steps need it."""
    path = folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
