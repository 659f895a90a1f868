"""Sinks: window tables, published artefacts, models, leaderboards."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources.published import BUCKETS, Published
from tidemark.sources.scratch import stored


def write_vectors(df: DataFrame, path: str) -> None:
    """Window vectors by split and variable; rows marked invalid stay out."""
    rows = df.where("not coalesce(invalid, false)") if "invalid" in df.columns else df
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("split", "variable").parquet(path)


def write_in_out(df: DataFrame, path: str, exclusive: bool = False) -> None:
    """Inside / outside results by mode and subject: replaces those of the written (mode, subject), or everything if exclusive.

    Subjects may be many, so they are dealt to BUCKETS folders by hash; the other results of a folder are written
    again. Writers at once need publish_in_out.
    """
    spark, key = df.sparkSession, F.to_json(F.struct("mode", "subject_id"))
    dealt = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not exclusive and fs.exists(at) and any(s.getPath().getName().startswith("bucket=") for s in fs.listStatus(at)):
        dealt = stored(dealt, "in_out")  # read several times
        met = F.broadcast(dealt.select("bucket").distinct())
        others = spark.read.parquet(path).join(met, "bucket").withColumn("_key", key).join(dealt.select(key.alias("_key")).distinct(), "_key", "left_anti")
        dealt = dealt.unionByName(others.drop("_key"), allowMissingColumns=True)
    dealt.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "static" if exclusive else "dynamic").partitionBy("bucket").parquet(path)


def write_by_value(df: DataFrame, by: str, path: str, files: int = 64) -> None:
    """One Parquet file a value of a partition column. A task keeps up to `files` of them open; only where it has more values
    are its rows sorted first."""
    conf, name = df.sparkSession.conf, "spark.sql.maxConcurrentOutputFileWriters"
    before = conf.get(name)
    conf.set(name, files)
    try:
        df.repartition(by).write.partitionBy(by).parquet(path)
    finally:
        conf.set(name, before)


def publish(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Artefacts (a column `artifact` names them): refused where the target exists, or replacing those of the same name."""
    if overwrite:
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("artifact").parquet(path)
    else:
        df.write.mode("errorifexists").partitionBy("artifact").parquet(path)


def publish_in_out(df: DataFrame, path: str, exclusive: bool = False) -> int:
    """write_in_out for readers that must see each version whole (see Published)."""
    return Published(df.sparkSession, path).replace(df, ["mode", "subject_id"], whole=exclusive)


def publish_artifacts(df: DataFrame, path: str, overwrite: bool = False) -> int:
    """publish in one step: of two writers of a new target one is refused; replacing is never seen half done."""
    table = Published(df.sparkSession, path)
    return table.replace(df, ["artifact"]) if overwrite else table.create(df, ["artifact"])


def read_published(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    return Published(spark, path).read(version)


def save_model(model, path: str) -> None:
    PipelineModel([model]).write().overwrite().save(path)


def load_model(path: str):
    return PipelineModel.load(path).stages[0]


def save_confusion(df: DataFrame, path: str, data_mode: str) -> None:
    df.write.mode("overwrite").parquet(f"{path}/data_mode={data_mode}")


def load_confusion(spark: SparkSession, path: str, data_mode: str) -> DataFrame:
    return spark.read.parquet(path).where(f"data_mode = '{data_mode}'")


def write_leaderboard(df: DataFrame, path: str, order: list) -> None:
    df.orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True)
