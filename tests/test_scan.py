"""Ordered series whose keys hold any share of the rows: bucket by bucket, as sequential rules give it."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions.scan import first, following, highest, last, lowest, mixed, previous, scan, total, with_halo
from tidemark.operators import episodes, intervals, windows


@pytest.fixture(scope="module")
def series():
    rng = random.Random(8)
    rows = []
    for key, n in (("hot", 300), ("cold", 20), (None, 7), ("one", 1)):
        t = -50
        for k in range(n):
            t += rng.choice([0, 1, 1, 2, 5, 40])
            rows.append((key, t, k, rng.choice([None, 1, 2, 3]), rng.random() < 0.5))
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def frame(spark, series):
    return spark.createDataFrame(series, "k string, t long, i long, v long, f boolean").repartition(4)


def by_key(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        out.setdefault(r[0], []).append(r)
    return out


@pytest.mark.parametrize("width", [1, 7, 10_000])
def test_scan_against_a_loop(frame, series, width):
    columns = {
        "upto": total(), "before": total("v", own=False), "after": total("v", own=False, ahead=True), "high": highest("v", own=False), "low": lowest("v"), "mix": mixed("v"), "near": last("v", own=False), "next": first("v"),
        "prev": previous("v"), "then": following("t", "v"),
    }
    got = {(r.k, r.i): r for r in scan(frame, ["k"], ["t", "i"], F.floor(F.col("t") / width), columns).collect()}
    assert len(got) == len(series)
    add = lambda vs, f=sum: f([v for v in vs if v is not None]) if any(v is not None for v in vs) else None
    for key, rows in by_key(series).items():
        v = [r[3] for r in rows]
        for n, r in enumerate(rows):
            g = got[key, r[2]]
            mix = 0
            for x in v[: n + 1]:
                mix ^= x or 0
            known = [x for x in v[:n] if x is not None]
            assert (g.upto, g.before, g.after, g.high, g.low) == (n + 1, add(v[:n]), add(v[n + 1 :]), add(v[:n], max), add(v[: n + 1], min))
            assert (g.mix or 0) == mix and g.near == (known[-1] if known else None) and g.next == next((x for x in v[n:] if x is not None), None)
            assert (g.prev is None if n == 0 else g.prev.v == v[n - 1]) and (g.then is None if n + 1 == len(rows) else (g.then.t, g.then.v) == (rows[n + 1][1], rows[n + 1][3]))


def test_an_empty_frame(frame):
    assert scan(frame.where("false"), ["k"], ["t"], F.col("t"), {"n": total()}).count() == 0


def test_one_hot_key_is_spread_over_tasks(spark):
    hot = spark.range(40_000).select(F.lit("s").alias("k"), F.col("id").alias("t"), (F.col("id") % 7 > 2).alias("out"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for done in (
            episodes.run_ids(hot, "k", ["t"], "out", bucket_us=500),
            episodes.sessionize(hot, "k", ["t"], 3, bucket_us=500),
            episodes.rolling_inside(hot, ["k"], "t", "out", 50, 2, bucket_us=500),
            windows.impute_linear(hot.withColumn("v", F.when(F.col("out"), F.col("t").cast("double"))), ["k"], "t", "v", 0.5, bucket_us=500),
            windows.row_position(hot, "k", ["t"], bucket_us=500),
            windows.thin(hot, "k", "t", 9, bucket_us=500),
        ):
            sizes = [r["count"] for r in done.groupBy(F.spark_partition_id().alias("p")).count().collect()]
            assert len(sizes) == 4 and max(sizes) < 0.5 * sum(sizes)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("width", [2, 30, 10_000])
def test_runs_episodes_and_sessions(frame, series, width):
    runs = {(r.k, r.i): r.run for r in episodes.run_ids(frame, "k", ["t", "i"], "v", bucket_us=width).collect()}
    cluster = {(r.k, r.i): r.cluster for r in episodes.sessionize(frame, "k", ["t", "i"], 4, bucket_us=width).collect()}
    found = {(r.k, r.start_us, r.end_us, r.n) for r in episodes.outside_episodes(frame, "k", ["t", "i"], "f", 3, bucket_us=width).collect()}
    episode = set()
    for key, rows in by_key(series).items():
        run, group = 0, 0
        for n, r in enumerate(rows):
            run += n == 0 or rows[n - 1][3] != r[3]
            group += n > 0 and r[1] - rows[n - 1][1] > 4
            assert runs[key, r[2]] == run and cluster[key, r[2]] == group
            if r[4] and (n == 0 or not rows[n - 1][4]):
                end = n
                while end + 1 < len(rows) and rows[end + 1][4]:
                    end += 1
                episode.add((key, rows[n - 1][1] if n else r[1] - 3, rows[end][1], end - n + 1))
    assert found == episode


@pytest.mark.parametrize("width", [1, 25, 10_000])
def test_rolling_and_imputed(frame, series, width):
    rolled = {(r.k, r.i): (r.n, round(r.frac_in, 9)) for r in episodes.rolling_inside(frame, ["k"], "t", "f", 12, 2, bucket_us=width).collect()}
    every = {(r.k, r.t): r.v for r in windows.impute_linear(frame.groupBy("k", "t").agg(F.max("v").cast("double").alias("v")), ["k"], "t", "v", 0.9, bucket_us=width).collect()}
    want, filled = {}, {}
    for key, rows in by_key(series).items():
        for r in rows:
            inside = [x[4] for x in rows if r[1] - 12 < x[1] <= r[1]]
            if len(inside) >= 2:
                want[key, r[2]] = (len(inside), round(1 - sum(inside) / len(inside), 9))
        values = {}
        for r in rows:
            values[r[1]] = max((x for x in (values.get(r[1]), r[3]) if x is not None), default=None)
        known = [(t, v) for t, v in values.items() if v is not None]
        if known and len(known) >= 0.1 * len(values):
            for t, v in values.items():
                a, b = [x for x in known if x[0] <= t], [x for x in known if x[0] >= t]
                filled[key, t] = v if v is not None else b[0][1] if not a else a[-1][1] if not b else a[-1][1] + (b[0][1] - a[-1][1]) * (t - a[-1][0]) / (b[0][0] - a[-1][0])
    assert rolled == want
    assert every.keys() == filled.keys() and all(abs(every[k] - filled[k]) < 1e-9 for k in filled)


@pytest.mark.parametrize("width", [None, 10, 45, 100_000])
@pytest.mark.parametrize("window", [1, 3, 10])
def test_thinning_in_buckets(frame, series, width, window):
    want = []
    for key, rows in by_key(series).items():
        kept = None
        for r in rows:
            if kept is None or r[1] >= kept + window:
                kept = r[1]
                want.append((key, kept))
    got = [tuple(r) for r in windows.thin(frame, "k", "t", window, width).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("width", [3, 10_000])
def test_subtraction_in_buckets(spark, width):
    rng = random.Random(2)
    valid, bad, at = [], [], 0
    for n in range(30):
        at += rng.randint(-5, 20)
        valid.append(("s", n, at, at + rng.randint(0, 40)))
    for _ in range(60):
        a = rng.randint(-10, 400)
        bad.append(("s", a, a + rng.randint(0, 9)))
    pieces = intervals.subtract(spark.createDataFrame(valid, "subject_id string, segment int, start_us long, end_us long"), spark.createDataFrame(bad, "subject_id string, start_us long, end_us long"), bucket_us=width).collect()
    owner = {}
    for _, n, a, b in sorted(valid, key=lambda v: (v[2], v[1])):
        for t in range(a, b):
            owner.setdefault(t, n)
    for _, a, b in bad:
        for t in range(a, b):
            owner.pop(t, None)
    assert sorted((t, p.segment) for p in pieces for t in range(p.start_us, p.end_us)) == sorted(owner.items())
    assert all(p.end_us > p.start_us for p in pieces)


def test_halos_reach_back(frame):
    placed = with_halo(frame, "t", 6, 10).collect()
    own = {(r.k, r.i): r._bucket for r in placed if not r._halo}
    assert len(own) == frame.count() and all(r._bucket == own[r.k, r.i] + 1 and r.t + 6 >= 10 * r._bucket for r in placed if r._halo)


def test_tasks_follow_the_number_of_rows(spark, monkeypatch):
    """Series shuffle to next to nothing, so tasks of so many bytes held all rows of a table."""
    rows = spark.range(20_000).selectExpr("cast(id div 20 as string) k", "id % 20 t", "id % 20 > 7 f")
    monkeypatch.setattr("tidemark.functions.scan.TASK_ROWS", 1000)
    runs = episodes.run_ids(rows, "k", ["t"], "f", bucket_us=1)
    sizes = [r["count"] for r in runs.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert len(sizes) > 10 and max(sizes) < 4000
    assert {(r.f, r.run, r.n) for r in runs.groupBy("f", "run").agg(F.count("*").alias("n")).collect()} == {(False, 1, 8000), (True, 2, 12_000)}
