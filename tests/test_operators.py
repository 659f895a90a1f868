"""Hand-sized fixtures for the operators, and twins in numpy."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import HOUR, MINUTE, SECOND, duration_seconds, serial_day, split_last, tolerant_ceil, tolerant_floor
from tidemark.operators import board, clean, episodes, features, intervals, labels, models, split, stats, windows
from tidemark.plans import signals


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) if len(cols) > 1 else r[cols[0]] for r in df.collect()), key=repr)


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_serial_day_and_scalars(spark):
    assert one(spark, serial_day(F.lit(45292.5))) == dt.datetime(2024, 1, 1, 12)
    assert one(spark, tolerant_floor(F.lit(2.999999))) == 3 and one(spark, tolerant_ceil(F.lit(3.000001))) == 3
    assert one(spark, duration_seconds(F.lit("123 seconds"))) == 123
    a, b = split_last(F.lit("rand_forest_pca"))
    assert one(spark, a) == "rand_forest" and one(spark, b) == "pca"


def test_sentinels(spark):
    df = spark.createDataFrame([(0, -99999.0), (1, 0.0), (2, -3.0), (3, 72.0)], "i int, value double")
    out = clean.implausible_to_null(clean.sentinel_to_null(df, "value", -99999.0), "value")
    assert [r.value for r in out.orderBy("i").collect()] == [None, None, None, 72.0]
    assert [r.value for r in clean.null_to_sentinel(out, "value", -1.0).orderBy("i").collect()] == [-1.0, -1.0, -1.0, 72.0]


@pytest.mark.parametrize("mode,start,end", [("before", -300, 0), ("mean", -300, 0), ("smooth", -300, 0), ("after", -1, 299), ("within", -150, 150)])
def test_window_bounds(spark, mode, start, end):
    df = spark.createDataFrame([(1000 * SECOND,)], "t long")
    a, b = windows.bounds("t", mode, 300 * SECOND)
    assert df.select(a, b).first()[:] == ((1000 + start) * SECOND, (1000 + end) * SECOND)


def test_window_bounds_rejects_unknown_modes():
    with pytest.raises(ValueError):
        windows.bounds("t", "sideways", 1)


def test_overlap(spark):
    df = spark.createDataFrame([("a", 200 * SECOND, 0, 1000 * SECOND)], "subject_id string, ts_us long, start_us long, end_us long")
    assert windows.overlap(df, "mean", 300 * SECOND, 0.0).count() == 0
    kept = windows.overlap(df, "count", 300 * SECOND, 0.5).first()
    assert kept.gap_us == 100 * SECOND and math.isclose(kept.gap_share, 1 / 3)


def test_assign(spark):
    seg = spark.createDataFrame([("a", 0, 0, 100), ("a", 1, 100, 200)], "subject_id string, segment int, start_us long, end_us long")
    points = spark.createDataFrame([("a", t) for t in (0, 99, 100, 200)], "subject_id string, ts_us long")
    for bucket in (None, 30):
        assert rows(intervals.assign(points, seg, bucket_us=bucket), "ts_us", "segment") == sorted([(0, 0), (99, 0), (100, 1)], key=repr)


def test_change_points(spark):
    q = spark.createDataFrame([("a", 0, 0), ("a", 20, 1), ("a", 40, 0)], "k string, t long, v int")
    out = intervals.change_points(q, "k", "t", "v", F.lit(100)).where("value != 0")
    assert rows(out, "start_us", "end_us") == [(20, 40)]


def test_subtract(spark):
    valid = spark.createDataFrame([("a", 0, 0, 100 * SECOND, 0, 1.0)], "subject_id string, segment int, start_us long, end_us long, startidx long, frequency double")
    bad = spark.createDataFrame([("a", a * SECOND, b * SECOND) for a, b in ((20, 30), (30, 40), (95, 120))], "subject_id string, start_us long, end_us long")
    out = intervals.with_samples(intervals.subtract(valid, bad), valid)
    got = rows(out, "start_us", "end_us", "length", "startidx")
    assert got == sorted([(0, 20 * SECOND, 20, 0), (40 * SECOND, 95 * SECOND, 55, 40)], key=repr)
    all_bad = spark.createDataFrame([("a", 0, 200 * SECOND)], bad.schema)
    assert intervals.subtract(valid, all_bad).count() == 0


def test_subtract_properties(spark):
    rng = random.Random(3)
    valid, bad = [], []
    for k in range(12):
        t = 0
        for s in range(4):
            a = t + rng.randint(0, 5)
            b = a + rng.randint(1, 30)
            valid.append((str(k), s, a, b))
            t = b
        for _ in range(6):
            a = rng.randint(0, 100)
            bad.append((str(k), a, a + rng.randint(0, 15)))
    out = intervals.subtract(spark.createDataFrame(valid, "subject_id string, segment int, start_us long, end_us long"), spark.createDataFrame(bad, "subject_id string, start_us long, end_us long")).collect()
    for k in range(12):
        inside = {(s, t) for q, s, a, b in valid if q == str(k) for t in range(a, b)} - {(s, t) for q, a, b in bad if q == str(k) for t in range(a, b) for s in range(4)}
        got = [(r.segment, t) for r in out if r.subject_id == str(k) for t in range(r.start_us, r.end_us)]
        assert len(got) == len(set(got)) and set(got) == inside


def test_overlapping_segments(spark):
    s = spark.createDataFrame([("a", 0, 0, 10), ("a", 1, 5, 20), ("a", 2, 20, 30)], "subject_id string, segment int, start_us long, end_us long")
    assert rows(intervals.overlapping(s), "segments", "overlaps") == [(3, 1)]


def test_thin(spark):
    df = spark.createDataFrame([("a", t) for t in (0, 290, 310, 600, 620)], "k string, t long")
    assert rows(windows.thin(df, "k", "t", 300), "t") == [0, 310, 620]


@pytest.mark.parametrize("values,expected", [([None, 2, 3, 4], [2, 2, 3, 4]), ([1, None, 3, 4], [1, 2, 3, 4]), ([1, None, 3, None], None), ([None] * 4, None)])
def test_impute(spark, values, expected):
    df = spark.createDataFrame([("w", i, None if v is None else float(v)) for i, v in enumerate(values)], "w string, t long, v double")
    out = [r.v for r in windows.impute_linear(df, ["w"], "t", "v").orderBy("t").collect()]
    assert out == ([] if expected is None else [float(v) for v in expected])


def test_impute_like_numpy(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=60)
    gone = rng.random(60) < 0.2
    df = spark.createDataFrame([("w", i, None if g else float(v)) for i, (v, g) in enumerate(zip(x, gone))], "w string, t long, v double")
    out = [r.v for r in windows.impute_linear(df, ["w"], "t", "v", 0.5).orderBy("t").collect()]
    at = np.arange(60)
    assert np.allclose(out, np.interp(at, at[~gone], x[~gone]))


def test_gap_fill(spark):
    df = spark.createDataFrame([("a", 0, 0, 2.0, [1.0, 2.0]), ("a", 1, 2 * SECOND, 2.0, [3.0])], "subject_id string, segment_id int, start_us long, frequency double, samples array<double>")
    out = [(r.rel_us, r.value) for r in windows.gap_fill(df).orderBy("rel_us").collect()]
    assert out == [(0, 1.0), (500_000, 2.0), (1_000_000, None), (1_500_000, None), (2_000_000, 3.0)]


def test_mean_rule(spark):
    df = spark.createDataFrame([(85.0, 80.0, 85.0), (86.0, 80.0, 85.0), (85.0, None, None)], "mean double, lower double, upper double")
    assert [r[0] for r in df.select(labels.mean_rule(None)).collect()] == [True, False, None]


def test_smooth_rule(spark):
    df = spark.createDataFrame([("a", i * MINUTE, m, 80.0, 95.0) for i, m in enumerate((90.0, 70.0, 100.0))], "k string, t long, mean double, lower double, upper double")
    for frac, expected in ((0.46, False), (0.7, True)):
        out = labels.smooth_rule(df, "k", "t", 3, MINUTE, frac).orderBy("t").collect()
        assert [r.inside for r in out] == [None, None, expected] and math.isclose(out[2].share_outside, 2 / 3)
    missing = df.withColumn("lower", F.when(F.col("t") != MINUTE, F.col("lower")))
    assert [r.inside for r in labels.smooth_rule(missing, "k", "t", 3, MINUTE).collect()] == [None] * 3


def test_count_rule(spark):
    df = spark.createDataFrame([("w", v, 80.0, 90.0) for v in (85.0, 85.0, 85.0, 95.0)] + [("u", 85.0, 80.0, 90.0), ("u", None, 80.0, 90.0)], "w string, value double, lower double, upper double")
    out = {r.w: r.inside for r in labels.count_rule(df, ["w"], F.lit(4)).collect()}
    assert out == {"w": True, "u": None}
    mostly_out = df.withColumn("value", F.col("value") + 8)
    assert {r.w: r.inside for r in labels.count_rule(mostly_out, ["w"], F.lit(4)).collect()}["w"] is False
    assert {r.w: r.inside for r in labels.count_rule(mostly_out, ["w"], F.lit(4), "count_signed").collect()}["w"] is None


def test_inside_share(spark):
    df = spark.createDataFrame([("a", True, 10), ("a", False, 30), ("a", True, 10), ("a", None, 99)], "k string, inside boolean, length long")
    r = labels.inside_share(df, "k").first()
    assert math.isclose(r.share_inside, 0.4) and math.isclose(r.share_outside, 0.6)


def _flags(spark, flags):
    return spark.createDataFrame([("a", i * MINUTE, bool(f)) for i, f in enumerate(flags)], "k string, t long, out boolean")


def test_episodes(spark):
    out = episodes.outside_episodes(_flags(spark, [0, 1, 1, 0, 0, 1]), "k", ["t"], "out", MINUTE)
    assert rows(out, "start_us", "end_us", "duration_us") == sorted([(0, 2 * MINUTE, 2 * MINUTE), (4 * MINUTE, 5 * MINUTE, MINUTE)], key=repr)
    first = episodes.outside_episodes(_flags(spark, [1, 0]), "k", ["t"], "out", MINUTE).first()
    assert first.start_us == -MINUTE


def test_sessionize(spark):
    df = spark.createDataFrame([("a", t * SECOND) for t in (0, 60, 121, 183)], "k string, t long")
    assert [r.cluster for r in episodes.sessionize(df, "k", ["t"], 61 * SECOND).orderBy("t").collect()] == [0, 0, 0, 1]


def test_rolling(spark):
    out = episodes.rolling_inside(_flags(spark, [1, 0, 0, 0, 0, 1, 1]), ["k"], "t", "out", 5 * MINUTE, 5).orderBy("t").collect()
    assert [r.t // MINUTE for r in out] == [4, 5, 6] and np.allclose([r.frac_in for r in out], [0.8, 0.8, 0.6])


@pytest.mark.parametrize("first,end,expected", [(90, 200, 0.0), (250, 200, None), (250, None, 150.0)])
def test_time_to_first(spark, first, end, expected):
    lab = spark.createDataFrame([("a", first * SECOND, 1.0)], "k string, ts_us long, lower double")
    rec = spark.createDataFrame([("a", 100 * SECOND, (end or 0) * SECOND)], "k string, start_us long, end_us long")
    assert episodes.time_to_first(lab, rec, "k", ["lower"], "end_us" if end else None).first().seconds_to_first == expected


def test_by_elapsed_fills_empty_steps(spark):
    df = spark.createDataFrame([("a", 0, True), ("a", 3 * MINUTE, True), ("b", 3 * MINUTE, False)], "k string, t long, out boolean")
    start = spark.createDataFrame([("a", 0), ("b", 0)], "k string, start_us long")
    assert rows(episodes.by_elapsed(df, start, "k", "t", "out", MINUTE), "step", "outside", "outside_per_recording") == [(0, 1, 0.5), (1, 0, 0.0), (2, 0, 0.0), (3, 1, 0.5)]


def test_tertiles(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 9)], "v double")
    assert [r.b for r in split.tertiles(df, "v", "b").orderBy("v").collect()] == [0, 0, 0, 1, 1, 2, 2, 2]


def test_histogram(spark):
    df = spark.createDataFrame([(float(i),) for i in range(5)], "v double")
    assert rows(stats.histogram(df, "v", 2), "bin", "n") == [(0, 2), (1, 3)]
    rng = np.random.default_rng(1).normal(size=500)
    h = stats.histogram(spark.createDataFrame([(float(x),) for x in rng], "v double"), "v", 20)
    got = dict(rows(h, "bin", "n"))
    assert [got.get(i, 0) for i in range(20)] == np.histogram(rng, 20)[0].tolist()


def test_downsample(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0, 6.0],)], "x array<double>")
    assert df.select(features.downsample("x", 3)).first()[0] == [2.0, 5.0]
    assert df.select(features.downsample("x", 3, "median")).first()[0] == [2.0, 5.0]


def test_auc_and_balance(spark):
    df = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1)], "s double, y int")
    assert models.roc_auc(df, "s", "y").first().auc == 0.75
    yh = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, yhat int")
    assert models.balanced_accuracy(yh).first().balanced_accuracy == 0.75
    assert rows(models.confusion(yh), "y", "yhat", "n") == [(0, 0, 1), (0, 1, 1), (1, 1, 2)]


def test_best_threshold(spark):
    rng = random.Random(5)
    data = [(rng.randint(0, 30) / 10, rng.randint(0, 1)) for _ in range(200)]
    r = models.best_threshold(spark.createDataFrame(data, "s double, y int"), "s", "y").first()
    p, q = sum(y for _, y in data), sum(1 - y for _, y in data)
    want = max((round((sum(y for s, y in data if s >= c) / p + sum(1 - y for s, y in data if s < c) / q) / 2, 12), -c) for c in {s for s, _ in data})
    assert (r.balanced_accuracy, -r.threshold) == pytest.approx(want)


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(p,) for p in (0.01, 0.02, 0.03, 0.5)], "p double")
    q = [r.q for r in stats.benjamini_hochberg(df, "p").orderBy("p").collect()]
    assert np.allclose(q, [0.04, 0.04, 0.04, 0.5]) and all(a <= b for a, b in zip(q, q[1:]))


def test_benjamini_hochberg_in_ranges_and_families(spark):
    rng = np.random.default_rng(9)
    ps = np.round(rng.random(400) ** 3, 3)
    df = spark.createDataFrame([(i, float(v), "ab"[i % 2]) for i, v in enumerate(ps)] + [(400, None, "a")], "i int, p double, f string")

    def want(v):
        order = np.argsort(v, kind="stable")
        raw = v[order] * len(v) / np.arange(1, len(v) + 1)
        out = np.empty(len(v))
        out[order] = np.minimum(1, np.minimum.accumulate(raw[::-1])[::-1])
        return out

    got = {r.i: r.q for r in stats.benjamini_hochberg(df, "p", parts=16).collect()}
    assert got[400] is None and np.allclose([got[i] for i in range(400)], want(ps))
    by = {r.i: r.q for r in stats.benjamini_hochberg(df, "p", ["f"]).collect()}
    assert np.allclose([by[i] for i in range(0, 400, 2)], want(ps[::2]))


def test_slices_and_offsets(spark):
    seg = spark.createDataFrame([("a", 0, 0, [1.0, 2.0, 3.0, 4.0]), ("a", 1, 50, [5.0])], "k string, segment int, start_us long, samples array<double>")
    cut = spark.createDataFrame([("a", 0, 1, 3)], "k string, segment int, startidx int, endidx int")
    assert windows.slice_samples(seg, cut, ["k", "segment"]).first().x == [2.0, 3.0]
    sized = windows.sample_offsets(seg.withColumn("length", F.size("samples")), "k", "length")
    assert rows(windows.row_position(sized, "k", ["start_us"]), "segment", "offset", "position") == [(0, 0, 0), (1, 4, 1)]


def test_pearson(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0), (3.0, 4.0), (4.0, 3.0), (5.0, 5.0), (None, 1.0)], "x double, y double")
    r = stats.pearson_pvalue(df, [("x", "y")]).first()
    assert r.n == 5 and math.isclose(r.r, 0.8) and math.isclose(r.p, 0.1040880, rel_tol=1e-4)


def test_ci(spark):
    df = spark.createDataFrame([(0.15,)], "s double")
    assert round(df.select(stats.ci_halfwidth("s")).first()[0], 4) == 0.0759


def test_robust_scaler(spark):
    df = spark.createDataFrame([("v", [float(i) for i in range(1, 12)])], "variable string, x array<double>")
    p = features.fit_scaler(df)
    r = p.first()
    assert r.centre == 6 and math.isclose(r.scale, 8)
    assert math.isclose(features.apply_scaler(df, p).first().x[-1], 0.625)


def test_lagged_correlation(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0], [1.0, 3.0, 2.0])], "x array<double>, y array<double>")
    got = [df.select(features.lagged_correlation(F.col("x"), F.col("y"), 3, lag)).first()[0] for lag in (-2, -1, 0, 1, 2)]
    assert np.allclose(got, [0, -0.5, 0.5, 0.5, -0.5])
    flat = spark.createDataFrame([([1.0, 1.0, 1.0], [1.0, 3.0, 2.0])], "x array<double>, y array<double>")
    assert flat.select(features.lagged_correlation(F.col("x"), F.col("y"), 3, 0)).first()[0] == 0


@pytest.mark.parametrize("length", [300, 299])
def test_lags(length):
    assert features.lag_list(length, 60) == [-240, -180, -120, -60, 0, 60, 120, 180]


def test_pareto(spark):
    df = spark.createDataFrame([(1, 0.70, 0.60), (2, 0.65, 0.65), (3, 0.60, 0.50), (4, 0.70, 0.60)], "id int, x double, y double")
    front = board.pareto_front(df, "x", "y")
    assert rows(front, "id") == [1, 2, 4]
    assert rows(board.pareto_front(front, "x", "y"), "id") == [1, 2, 4]


def test_pareto_like_brute_force(spark):
    rng = random.Random(2)
    pts = [(i, rng.randint(0, 40) / 40, rng.randint(0, 40) / 40) for i in range(300)]
    want = sorted(i for i, x, y in pts if not any(a >= x and b >= y and (a > x or b > y) for _, a, b in pts))
    assert sorted(r.id for r in board.pareto_front(spark.createDataFrame(pts, "id int, x double, y double"), "x", "y").collect()) == want


def test_group_kfold(spark):
    rng = random.Random(1)
    data = [(g, rng.randint(0, 1)) for g in range(60) for _ in range(rng.randint(1, 20))]
    folds = split.group_kfold(spark.createDataFrame(data, "g int, y int"), "y", "g", 5, 3).collect()
    assert len(folds) == 180 and {(r.g, r.repeat) for r in folds} == {(g, k) for g in range(60) for k in range(3)}
    assert {r.fold for r in folds} == set(range(5))


def test_stratified_split(spark):
    data = [(i, "abc"[i % 3] if i < 50 else "d") for i in range(73)]
    out = split.stratified_split(spark.createDataFrame(data, "id int, s string"), "id", "s").collect()
    assert sum(r.split == "train" for r in out) == round(73 * 0.8)
    for s in "abcd":
        n = sum(r.s == s for r in out)
        assert abs(sum(r.s == s and r.split == "train" for r in out) - 0.8 * n) < 1


def test_expect_and_rejects(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", None, None), ("b", None, 2.0), ("b", 1.0, None)], "k string, x double, y double")
    assert dict(rows(clean.expect(df, {"x": F.col("x").isNotNull(), "y": F.col("y") > 1}), "rule", "violations")) == {"x": 2, "y": 3}
    assert rows(clean.reject_all_null(df, "k", ["x", "y"]), "k") == ["b"]


def test_power_and_mutual_information(spark):
    rng = np.random.default_rng(4)
    x = np.exp(rng.normal(size=400))
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    lam = features.fit_power(df, "v")
    assert -2 <= lam < 0.5
    z = [r.z for r in features.power_transform(df, "v", lam, "z").collect()]
    assert abs(np.mean(z)) < 1e-9 and abs(np.std(z) - 1) < 1e-9
    y = rng.integers(0, 2, 300)
    mi = dict(rows(features.mutual_information(spark.createDataFrame([(int(c), [float(c) + 0.01 * float(e), float(e)]) for c, e in zip(y, rng.normal(size=300))], "y int, x array<double>"), "y"), "feature", "mi"))
    assert mi[0] > 0.4 > mi[1]


def test_samples_in_is_the_same_with_salt(spark):
    lab = spark.createDataFrame([("a", t * HOUR) for t in range(3, 20, 2)], "subject_id string, ts_us long")
    sig = spark.createDataFrame([("a", t * HOUR // 2, float(t)) for t in range(40)], "subject_id string, ts_us long, value double")
    a, b = (rows(windows.samples_in(lab, sig, "within", 3 * HOUR, salt=s), "ts_us", "at_us") for s in (1, 3))
    assert a == b and len(a) == 9 * 6 - 1  # the last window reaches beyond the samples


@pytest.fixture(scope="session")
def few_events(spark, tmp_path_factory):
    """Events of subjects and variables that no query may leave out."""
    d = tmp_path_factory.mktemp("events")
    at = dt.datetime(2024, 1, 1)
    data = [(k, at + dt.timedelta(days=k % 2, microseconds=k), k % 5 * 1000 + 1, ["view", "click", "error", "new kind"][k % 4], [50.0, 3.0, 72.0, 95.0, None][k % 5] if k % 3 else 20.0 + k) for k in range(60)]
    spark.createDataFrame(data, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(f"{d}/events.parquet")
    return str(d), data


def test_pivot_in_long_form_holds_all_subjects_and_variables(spark, few_events):
    d, data = few_events
    want = {}
    for _, ts, user, kind, value in data:
        key = ((ts - dt.datetime(1970, 1, 1)).days, kind, str(user))
        want[key] = min((v for v in (want.get(key), value) if v is not None), default=None)
    got = signals.pivot_by_time_long(spark, d).collect()
    assert len(got) == len(want) and {(r.day, r.variable, r.subject_id): r.value for r in got} == want


def test_cleaning_holds_all_events_without_error(spark, few_events):
    d, data = few_events
    want = []
    for _, ts, user, kind, value in data:
        value = value if value is not None and value != 50 and value > 5 else None
        if kind != "error" and (value is None or value <= 90):
            want.append((str(user), (ts - dt.datetime(1970, 1, 1)) // dt.timedelta(microseconds=1), -99999.0 if value is None else value, value))
    assert {ts % 2 for _, ts, _, _ in want} == {0, 1}
    assert rows(signals.clean_signal_all(spark, d), "subject_id", "ts_us", "stored", "value") == sorted(want, key=repr)


def test_parts_per_subject_collects_no_list(spark, few_events):
    plan = signals.parts_per_subject(spark, few_events[0])._jdf.queryExecution().executedPlan().toString()
    assert "min(segment" in plan and "collect_list" not in plan
