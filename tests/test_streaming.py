"""Order-dependent streaming operators give what the batch operators give, on shuffled and late input."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import episodes, windows
from tidemark.streaming import ordered

START = datetime(2024, 1, 1)
SECOND = 1_000_000


@pytest.fixture(scope="module")
def recorded(spark, tmp_path_factory):
    """Rows of three subjects in five files; a row is late by up to 200 s, and comes up to two files after its time."""
    rng = random.Random(7)
    rows = []
    for subject, n in (("a", 120), ("b", 60), ("c", 3)):
        t = 0
        for _ in range(n):
            t += rng.choice([1, 2, 5, 20])
            rows.append((subject, START + timedelta(seconds=t), rng.choice([True, True, False, None])))
    rows.sort(key=lambda r: r[1].timestamp() + rng.uniform(0, 200))
    path = tmp_path_factory.mktemp("stream")
    schema = "subject_id string, ts timestamp, out boolean"
    for k in range(5):
        part = rows[k * len(rows) // 5 : (k + 1) * len(rows) // 5]
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(path / f"{k}"))
    spark.createDataFrame([("end", START + timedelta(days=40 + k), False) for k in range(2)], schema).coalesce(1).write.parquet(str(path / "9"))  # moves the watermark past all rows
    return path, schema, spark.createDataFrame(rows, schema).withColumn("ts_us", F.unix_micros("ts"))


def streamed(spark, recorded, tmp_path, make, name):
    path, schema, _ = recorded
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(path))
    q = make(source).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(processingTime="0 seconds").start()
    try:
        q.processAllAvailable()
        return sorted(tuple(r) for r in spark.table(name).where("subject_id != 'end'").collect())
    finally:
        q.stop()


def test_episodes(spark, recorded, tmp_path):
    got = streamed(spark, recorded, tmp_path, lambda s: ordered.outside_episodes(s, "out", SECOND, "1 hour"), "episodes")
    batch = episodes.outside_episodes(recorded[2], "subject_id", ["ts_us"], "out", SECOND)
    want = sorted(tuple(r) for r in batch.select("subject_id", "start_us", "end_us", "n", "duration_us").collect())
    assert got == want and len(got) > 20


def test_thinning(spark, recorded, tmp_path):
    got = streamed(spark, recorded, tmp_path, lambda s: ordered.thin(s, 30 * SECOND, "1 hour"), "thinned")
    assert got == sorted(tuple(r) for r in windows.thin(recorded[2], "subject_id", "ts_us", 30 * SECOND).collect()) and got


def test_late_rows_go_and_idle_subjects_are_forgotten(spark, tmp_path):
    schema = "subject_id string, ts timestamp, out boolean"
    files = [[("a", 0, True), ("a", 10, True), ("z", 5000, False)], [("z", 5001, False)], [("a", 5, False), ("a", 9000, True), ("z", 99999, False)], [("z", 100000, False)]]
    for k, rows in enumerate(files):
        spark.createDataFrame([(s, START + timedelta(seconds=t), f) for s, t, f in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    got = streamed(spark, (tmp_path / "in", schema, None), tmp_path, lambda s: ordered.outside_episodes(s, "out", SECOND, "60 seconds", expiry_us=1000 * SECOND), "late")
    at = lambda s: int((START - datetime(1970, 1, 1)).total_seconds() + s) * SECOND
    assert [r for r in got if r[0] == "a"] == [("a", at(-1), at(10), 2, 11 * SECOND), ("a", at(8999), at(9000), 1, SECOND)]
