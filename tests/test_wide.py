"""Principal components against a singular value decomposition, nearest neighbours against all pairs."""

import numpy as np
import pyarrow as pa
import pytest

from tidemark.operators import neighbours, pca


def frame(spark, a, tmp):
    spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(a)], "id long, x array<double>").repartition(5).write.parquet(str(tmp / "a"))
    return spark.read.parquet(str(tmp / "a"))


def twin(a, variance):
    _, s, w = np.linalg.svd(a - a.mean(0), full_matrices=False)
    values = s**2 / (len(a) - 1)
    k = int(np.flatnonzero(np.cumsum(values) > variance * values.sum())[0]) + 1
    return values, w, k


@pytest.mark.parametrize("n,d,block", [(300, 20, None), (12, 40, None), (200, 700, 24), (60, 20_000, None)])
def test_components_like_svd(spark, tmp_path, n, d, block):
    rng = np.random.default_rng(d)
    a = (rng.normal(size=(n, 15)) * 0.7 ** np.arange(15)) @ rng.normal(size=(15, d)) + 0.02 * rng.normal(size=(n, d)) + 5
    found = pca.fit(frame(spark, a, tmp_path), variance=0.95, block=block)
    values, w, k = twin(a, 0.95)
    assert len(found.values) == k and np.abs(found.values - values[:k]).max() <= 1e-6 * values[0]
    assert np.abs((found.vectors * w[:k]).sum(1)).min() > 1 - 1e-6 and abs(sum(found.shares()) - values[:k].sum() / values.sum()) < 1e-9


def test_components_of_the_given_vectors(spark, sf_dir):
    v = spark.read.parquet(f"{sf_dir}/embeddings.parquet").selectExpr("vec_id as id", "embedding as x")
    a = np.array([r.x for r in v.collect()])
    train, test, shares = pca.by_variance(v, v, variance=0.9)
    values, w, k = twin(a, 0.9)
    assert len(shares) == k and np.abs(np.array(shares) - values[:k] / values.sum()).max() < 1e-9
    got = {r.id: r.x for r in train.collect()}
    want = (a - a.mean(0)) @ w[:k].T
    assert all(np.abs(np.abs(got[r.id]) - np.abs(y)).max() < 1e-6 for r, y in zip(v.collect(), want)) and test.count() == len(a)


def test_awkward_arrays(spark, tmp_path):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "id long, x array<double>")
    assert len(pca.fit(same).values) == 2 and pca.fit(same).shares() == [0.0, 0.0]
    assert len(pca.fit(same.where("false")).values) == 0
    with_null = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [3.0, 2.0])], "id long, x array<double>")
    assert np.allclose(pca.fit(with_null).values, [2.0])
    flat = np.random.default_rng(1).normal(size=(150, 60))  # no gaps in the spectrum: passes end all the same
    found = pca.fit(frame(spark, flat, tmp_path), variance=0.5, block=16, steps=6)
    assert sum(found.shares()) > 0.5 and np.allclose(found.vectors @ found.vectors.T, np.eye(len(found.values)), atol=1e-9)


def all_pairs(a, queries, k):
    out = []
    for i in queries:
        d = np.sqrt(((a - a[i]) ** 2).sum(1))
        order = [j for j in np.lexsort((np.arange(len(a)), d)) if j != i][:k]
        out += [(i, int(j), r + 1, round(float(d[j]), 9)) for r, j in enumerate(order)]
    return sorted(out)


def clusters(n, many, d, seed=3):
    rng = np.random.default_rng(seed)
    return 20 * rng.normal(size=(many, d))[rng.integers(0, many, n)] + rng.normal(size=(n, d))


@pytest.mark.parametrize("kind", ["even", "clusters", "copies", "line"])
def test_nearest_like_all_pairs(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "MEET", 40)
    rng = np.random.default_rng(5)
    a = {"even": rng.normal(size=(400, 8)), "clusters": clusters(900, 30, 6), "copies": np.repeat(rng.normal(size=(12, 5)), 30, 0), "line": np.outer(np.arange(300) ** 2.0, np.ones(3))}[kind]
    df = spark.createDataFrame([(i, r.tolist(), i % 3) for i, r in enumerate(a)], "id long, x array<double>, label int").repartition(3)
    near = neighbours.knn_join(df.where("id % 7 = 0"), df, "id", "nid", "x", "label", 5, cell_rows=25)
    assert sorted((r.id, r.nid, r.rank, round(r.distance, 9)) for r in near.collect()) == all_pairs(a, range(0, len(a), 7), 5)


def test_few_pairs_are_compared_on_clusters(spark):
    a = clusters(3000, 40, 8)
    df = spark.createDataFrame([(i, r.tolist(), 0) for i, r in enumerate(a)], "id long, x array<double>, label int")
    found = neighbours.visits(df.where("id % 10 = 0"), df, "id", "id", "x", "label", 5, cell_rows=100)
    compared = found.where("t is null").groupBy().sum("compared").first()[0]
    assert compared < 0.25 * 300 * 3000


def test_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [0.0, 1.0], 1), (2, [0.0, 3.0], 1), (3, None, 0), (None, [1.0, 1.0], 0)], "id long, x array<double>, label int")
    rows = neighbours.knn_join(df, df, "id", "nid", "x", "label", 4).collect()
    assert sorted((r.id, r.nid, r.rank, r.distance) for r in rows) == [(1, 2, 1, 2.0), (2, 1, 1, 2.0)]
    assert neighbours.knn_join(df, df.where("false"), "id", "nid", "x", "label", 4).count() == 0
    assert neighbours.knn_join(df.where("false"), df, "id", "nid", "x", "label", 4).count() == 0


def test_correlations_at_all_lags(spark):
    from pyspark.sql import functions as F

    from tidemark.operators import features

    rng = np.random.default_rng(8)
    rows = [(k, rng.normal(size=n).tolist(), rng.normal(size=n).tolist()) for k, n in enumerate([50, 50, 3, 1, 300, 50])]
    rows += [(10, [1.0] * 50, rng.normal(size=50).tolist()), (11, None, [1.0]), (12, [1.0, 2.0], [1.0]), (13, [], []), (14, [1.0, None, 3.0], [1.0, 2.0, 4.0])]
    df = spark.createDataFrame(rows, "k int, x array<double>, y array<double>").repartition(2)
    lags = [-299, -60, -2, -1, 0, 1, 2, 7, 49]
    got = {r.k: r.c for r in df.select("k", features.lagged_correlations(F.col("x"), F.col("y"), lags).alias("c")).collect()}
    for k, x, y in rows[:7]:
        x, y = np.array(x), np.array(y)
        n, s = len(x), x.std() * y.std() * len(x)
        for lag, c in zip(lags, got[k]):
            pairs = [(x[i + lag] - x.mean()) * (y[i] - y.mean()) for i in range(n) if 0 <= i + lag < n]
            assert abs(c - (sum(pairs) / s if s > 1e-12 else 0)) < 1e-12
    assert got[11] is None and all(got[k] == [0.0] * len(lags) for k in (10, 12, 13, 14))


def test_visits_leave_in_bounded_batches():
    """All visits of 256 queries in one batch, each with its query's vector, grew with the number of cells."""
    class Held:
        def __init__(self, value):
            self.value = value

    rng = np.random.default_rng(3)
    pivots, v = rng.normal(size=(300, 4)), rng.normal(size=(500, 4))
    best = np.array([(c, 9.0) for c in range(300) for _ in range(3)])
    cells = np.array([(c, 0, 0.0, 99.0) for c in range(300)])
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(v.tolist(), pa.list_(pa.float64()))], ["_q", "_v"])
    out = list(neighbours._route(Held(pivots), Held((best, cells)), 2)([batch]))
    assert max(b.num_rows for b in out) <= 4096
    pairs = pa.Table.from_batches(out)
    assert set(zip(pairs["_q"].to_pylist(), pairs["cell"].to_pylist())) == {(q, c) for q in range(500) for c in range(300)} and pairs.num_rows == 150_000
    assert np.array_equal(np.array(pairs["_v"].to_pylist()), v[pairs["_q"].to_numpy()])
