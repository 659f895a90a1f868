"""Mutual information from nearest neighbours against the formula in numpy, and SQL of the fixed rank."""

import numpy as np
import pytest

from tidemark.operators import features


def digamma(n):
    n = np.asarray(n, int)
    harmonic = np.concatenate([[0.0], np.cumsum(1 / np.arange(1, n.max() + 1))])
    return harmonic[n - 1] - 0.57721566490153286


def twin(v, y, k=3):
    """The estimate of one feature: neighbours within the class, counts within the k-th one's distance."""
    labels, sizes = np.unique(y, return_counts=True)
    big = dict(zip(labels, sizes))
    use = np.array([big[c] > 1 for c in y])
    v, y = v[use], y[use]
    ks, ms, ns = [], [], []
    for i in range(len(v)):
        d = np.sort(np.abs(np.delete(v, i)[np.delete(y, i) == y[i]] - v[i]))
        kk = min(k, big[y[i]] - 1)
        r = d[kk - 1]
        d_all = np.abs(v - v[i])
        ks.append(kk)
        ns.append(big[y[i]])
        ms.append((d_all < r).sum() if r > 0 else (d_all == 0).sum())
    return max(0.0, digamma([len(v)])[0] + digamma(ks).mean() - digamma(ns).mean() - digamma(ms).mean())


@pytest.mark.parametrize("parts", [1, 2, 7, 64])
def test_like_the_formula(spark, parts):
    rng = np.random.default_rng(4)
    n = 260
    y = rng.integers(0, 3, n)
    y[:1], y[1:3] = 8, 9  # a class of one, and one of two
    x = np.stack([rng.normal(size=n), y + rng.normal(size=n), np.round(y + rng.normal(size=n)), np.where(y == 1, 5.0, rng.normal(size=n)), np.sort(rng.normal(size=n))[np.argsort(np.argsort(y, kind="stable"))]], 1)
    df = spark.createDataFrame([(int(c), r.tolist()) for c, r in zip(y, x)] + [(None, [1.0] * 5)], "y int, x array<double>").repartition(3)
    got = {r.feature: r.mi for r in features.mutual_information_near(df, "y", parts=parts).collect()}
    want = {j: twin(x[:, j], y) for j in range(5)}
    assert got.keys() == want.keys() and all(abs(got[j] - want[j]) < 1e-9 for j in want), (got, want)
    assert sorted(got, key=got.get) == sorted(want, key=want.get) and got[4] > got[1] > got[0]


def test_given_vectors(spark, sf_dir):
    from tidemark.plans import matrix
    from tidemark.sources import tables

    rows = tables.vectors(spark, sf_dir).collect()
    x, y = np.array([r.x for r in rows]), np.array([r.label % 2 for r in rows])
    got = {r.feature: r.mi for r in matrix.mutual_info_near(spark, sf_dir).collect()}
    assert len(got) == x.shape[1] and all(abs(got[j] - twin(x[:, j], y)) < 2e-9 for j in range(x.shape[1]))


def test_digamma(spark):
    from pyspark.sql import functions as F

    rows = spark.range(1, 2000).select("id", features.digamma(F.col("id")).alias("d")).collect()
    assert max(abs(r.d - digamma([r.id])[0]) for r in rows) < 1e-12
