"""Published tables: versions are whole, killed writers change nothing, of two writers one wins."""

import json
from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

from tidemark.sources import sinks
from tidemark.sources.published import BUCKETS, Published

SCHEMA = "mode string, subject_id string, n int"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_partitions_are_replaced(spark, tmp_path):
    path = str(tmp_path / "io")
    first = [("mean", "01", 1), ("mean", "2", 2), ("mean", None, 3), ("count", "a/b=c %", 4), ("", "", 5)]
    sinks.publish_in_out(spark.createDataFrame(first, SCHEMA).repartition(3), path)
    before = sinks.read_published(spark, path)
    assert rows(before) == sorted(first, key=repr) and before.schema.simpleString() == "struct<mode:string,subject_id:string,n:int>"
    sinks.publish_in_out(spark.createDataFrame([("mean", "01", 9), ("mean", "new", 8), ("mean", None, 7)], SCHEMA), path)
    assert rows(sinks.read_published(spark, path)) == sorted([("mean", "01", 9), ("mean", "2", 2), ("mean", None, 7), ("count", "a/b=c %", 4), ("", "", 5), ("mean", "new", 8)], key=repr)
    assert rows(before) == sorted(first, key=repr)  # a reader keeps the version that it began with
    assert rows(sinks.read_published(spark, path, 0)) == sorted(first, key=repr)
    sinks.publish_in_out(spark.createDataFrame([("mean", "2", 0)], SCHEMA), path, exclusive=True)
    assert rows(sinks.read_published(spark, path)) == [("mean", "2", 0)]
    sinks.publish_in_out(spark.createDataFrame([], SCHEMA), path, exclusive=True)
    assert rows(sinks.read_published(spark, path)) == []


def test_create_refuses_what_is_there(spark, tmp_path):
    df = spark.createDataFrame([("x", 1)], "artifact string, n int")
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, str(tmp_path / "p"))
    assert sinks.publish_artifacts(df, str(tmp_path / "p")) == 0
    with pytest.raises(FileExistsError):
        sinks.publish_artifacts(df, str(tmp_path / "p"))
    assert sinks.publish_artifacts(df, str(tmp_path / "p"), overwrite=True) == 1
    with pytest.raises(FileNotFoundError):
        sinks.read_published(spark, str(tmp_path / "p"), 5)


def test_a_killed_writer_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "k")
    sinks.publish_in_out(spark.createDataFrame([("mean", "a", 1)], SCHEMA), path)

    def killed(*a):
        raise KeyboardInterrupt

    monkeypatch.setattr(Published, "_publish", killed)
    with pytest.raises(KeyboardInterrupt):
        sinks.publish_in_out(spark.createDataFrame([("mean", "a", 2)], SCHEMA), path, exclusive=True)
    monkeypatch.undo()
    assert rows(sinks.read_published(spark, path)) == [("mean", "a", 1)]
    sinks.publish_in_out(spark.createDataFrame([("mean", "b", 3)], SCHEMA), path)
    assert rows(sinks.read_published(spark, path)) == [("mean", "a", 1), ("mean", "b", 3)]


def test_writers_at_once(spark, tmp_path):
    path = str(tmp_path / "w")
    with ThreadPoolExecutor(6) as pool:
        done = list(pool.map(lambda k: sinks.publish_in_out(spark.createDataFrame([("mean", str(k), k)], SCHEMA), path), range(6)))
    assert sorted(done) == list(range(6)) and rows(sinks.read_published(spark, path)) == [("mean", str(k), k) for k in range(6)]

    def create(k):
        try:
            return sinks.publish_artifacts(spark.createDataFrame([("x", k)], "artifact string, n int"), str(tmp_path / "c"))
        except FileExistsError:
            return None

    with ThreadPoolExecutor(4) as pool:
        assert sorted(map(repr, pool.map(create, range(4)))) == ["0", "None", "None", "None"]


def test_folders_dont_grow_with_subjects(spark, tmp_path):
    """A folder a subject took longer than in proportion to list, to replace and to read."""
    many = spark.range(3000).selectExpr("'mean' mode", "cast(id as string) subject_id", "cast(id as int) n")
    new = many.where("n % 2 = 0").withColumn("n", F.lit(-1)).unionByName(spark.createDataFrame([("mean", None, 7), ("", "0", 8)], SCHEMA))
    want = rows(many.where("n % 2 = 1").unionByName(new))
    sinks.write_in_out(many, str(tmp_path / "io"))
    sinks.write_in_out(new, str(tmp_path / "io"))
    assert rows(spark.read.parquet(str(tmp_path / "io")).select("mode", "subject_id", "n")) == want
    assert len(list((tmp_path / "io").rglob("*.parquet"))) <= BUCKETS
    sinks.publish_in_out(many, str(tmp_path / "v"))
    sinks.publish_in_out(new, str(tmp_path / "v"))
    assert rows(sinks.read_published(spark, str(tmp_path / "v"))) == want
    assert len(list((tmp_path / "v").rglob("*.parquet"))) <= 3 * BUCKETS


def test_a_version_with_a_folder_a_partition_is_taken_over(spark, tmp_path):
    df = spark.createDataFrame([("mean", "a", 1), ("mean", "b", 2)], SCHEMA)
    table = Published(spark, str(tmp_path))
    for s in "ab":
        df.where(F.col("subject_id") == s).write.parquet(f"{tmp_path}/data/x/{s}")
    table._publish(0, {"schema": json.loads(df.schema.json()), "folders": {s: f"data/x/{s}" for s in "ab"}})
    assert rows(table.read()) == rows(df)
    sinks.publish_in_out(spark.createDataFrame([("mean", "b", 3)], SCHEMA), str(tmp_path))
    assert rows(table.read()) == [("mean", "a", 1), ("mean", "b", 3)] and rows(table.read(0)) == rows(df)
