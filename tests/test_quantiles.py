"""Exact percentiles by radix selection."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import ranged
from tidemark.operators import features, split, stats

SHARES = [0.0, 0.1, 1 / 3, 0.5, 0.9, 0.999, 1.0]


@pytest.fixture(scope="module")
def values():
    rng = random.Random(4)
    groups = {
        "even": [rng.gauss(0, 1) for _ in range(900)],
        "ties": [float(rng.choice([1, 1, 1, 2, -3])) for _ in range(700)],
        "outlier": [rng.random() for _ in range(400)] + [1e300, -1e300, 5e-324, -5e-324, 0.0, -0.0],
        "edge": [7.0] * 500 + [7.0 + k * 1e-12 for k in range(500)],
        "few": [3.0, 1.0, 2.0],
        None: [float(k) for k in range(300)],
        "none": [],
    }
    rows = [(g, v) for g, vs in groups.items() for v in [*vs, None]]
    rng.shuffle(rows)
    return groups, rows


@pytest.mark.parametrize("held", [0, 100, ranged.HELD])
def test_against_numpy(spark, values, held):
    groups, rows = values
    df = spark.createDataFrame(rows, "g string, v double").repartition(3)
    got = {r.g: r.q for r in ranged.exact_percentiles(df, F.col("v"), SHARES, ["g"], held).collect()}
    assert set(got) == {g for g, v in groups.items() if v}
    for g, q in got.items():
        assert np.allclose(q, np.quantile(groups[g], SHARES), rtol=1e-12, atol=1e-300), g
    every = [v for _, v in rows if v is not None]
    (row,) = ranged.exact_percentiles(df, F.col("v"), SHARES, None, held).collect()
    assert np.allclose(row.q, np.quantile(every, SHARES), rtol=1e-12)


def test_bits_have_the_order_of_doubles(spark):
    xs = [-math.inf, -1e300, -2.5, -5e-324, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, math.inf, math.nan]
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(xs)], "k int, x double").withColumn("b", ranged.ordered_bits(F.col("x"))).withColumn("back", ranged.from_ordered_bits(F.col("b"))).orderBy("b").collect()
    assert [r.k for r in rows] == list(range(len(xs))) and all(r.x == r.back or math.isnan(r.x) for r in rows)
    zeros = spark.createDataFrame([(0.0,), (-0.0,)], "x double").select(ranged.ordered_bits(F.col("x")).alias("b")).distinct()
    assert zeros.count() == 1


def test_a_pass_holds_no_more_counts_than_digits(spark):
    """However many different values: counts of one pass are per 16 bits."""
    df = spark.range(200_000).select(F.rand(1).alias("v"))
    (row,) = ranged.exact_percentiles(df, F.col("v"), [0.25, 0.5], None, 1000).collect()
    assert np.allclose(row.q, np.quantile([r.v for r in df.collect()], [0.25, 0.5]), rtol=1e-15)


def test_no_rows(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert ranged.exact_percentiles(df, F.col("v"), [0.5], ["g"]).count() == 0
    assert [r.n for r in stats.describe(df, "v").collect()] == [0]


def test_callers_agree_on_both_ways(spark, values, monkeypatch):
    _, rows = values
    df = spark.createDataFrame([(g or "-", v) for g, v in rows if g != "outlier"], "variable string, v double")
    arrays = df.where("v is not null").groupBy("variable").agg(F.collect_list("v").alias("x"))
    near = lambda x: float(f"{x:.9g}") if isinstance(x, float) else x
    run = lambda: (sorted([near(x) for x in r] for r in stats.describe(df, "v", ["variable"]).collect()), sorted([near(x) for x in r] for r in features.fit_scaler(arrays).collect()), sorted((r.v, r.b) for r in split.tertiles(df.where("v is not null"), "v", "b").collect()))
    plain = run()
    monkeypatch.setattr(ranged.exact_percentiles, "__defaults__", (None, 10))
    assert repr(run()) == repr(plain)


def test_adjusted_p_of_many_rows_ties_and_families(spark, capsys):
    """A frame from the row to the last one is worked out anew for each row: the square of a range's rows."""
    rng = np.random.default_rng(4)
    ps = np.concatenate([rng.random(60_000), np.full(20_000, 0.25)])
    df = spark.createDataFrame(pd.DataFrame({"i": np.arange(len(ps)), "p": ps, "f": np.arange(len(ps)) % 2}))

    def want(v):
        order = np.argsort(v, kind="stable")
        out = np.empty(len(v))
        out[order] = np.minimum(1, np.minimum.accumulate((v[order] * len(v) / np.arange(1, len(v) + 1))[::-1])[::-1])
        return out

    for parts in (1, 5):
        done = stats.benjamini_hochberg(df, "p", parts=parts)
        done.explain()
        assert "currentrow$(), unboundedfollowing$()" not in capsys.readouterr().out
        got = done.toPandas().sort_values("i")
        assert np.array_equal(got["q"].to_numpy(), want(ps))
    got = stats.benjamini_hochberg(df, "p", ["f"]).toPandas().sort_values("i")
    assert all(np.array_equal(got["q"].to_numpy()[k::2], want(ps[k::2])) for k in (0, 1))
