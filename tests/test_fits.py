"""Fitted models against twins: many fits at once against one by one, against MLlib, and against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import models, split, stacked


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    n, d = 240, 6
    x = rng.normal(size=(n, d)) * [1, 5, 0.1, 1, 1, 0] + [0, 0, 3, 0, 0, 2]
    y = (x[:, 0] + x[:, 1] / 5 + rng.normal(size=n) > 0.8).astype(int)
    rows = [(i, i % 60, x[i].tolist(), int(y[i]), [i % 60 % 3, (i % 60 * 7) % 5 % 3]) for i in range(n)]
    return spark.createDataFrame(rows, "id int, g int, x array<double>, y int, f array<int>").repartition(3).cache()


FITS = [stacked.Fit(r, a, rep, fold) for r in (0.001, 0.05, 1.0) for a in (0.0, 0.5, 1.0) for rep, fold in ((0, 1), (1, 2), (0, None))]


def test_together_like_one_by_one(data, monkeypatch):
    every = stacked.fit(data, "x", "y", "f", FITS)
    for k in (0, 4, 11, 17, 26):
        assert np.abs(stacked.fit(data, "x", "y", "f", [FITS[k]])[0] - every[k]).max() < 1e-7
    monkeypatch.setattr(stacked, "HELD", 5 * 49)  # five at a time
    assert np.abs(stacked.fit(data, "x", "y", "f", FITS) - every).max() < 1e-7


@pytest.mark.parametrize("k", [0, 5, 10, 13, 17])
def test_like_separate_fits(data, k):
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    f = FITS[k]
    mine = data if f.fold is None else data.where(F.get("f", F.lit(f.repeat)) != f.fold)
    train = models.weighted(mine.withColumns({"_x": array_to_vector("x"), "_y": F.col("y").cast("double")}))
    m = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=f.regParam, elasticNetParam=f.elasticNetParam, maxIter=2000, tol=1e-14).fit(train)
    got = stacked.fit(data, "x", "y", "f", [f])[0]
    assert np.abs(got - np.append(m.coefficients.toArray(), m.intercept)).max() < 1e-5 * max(1, np.abs(got).max())


def test_gradient_is_zero(data):
    """The optimum of the penalized loss, checked with numpy alone."""
    rows = data.collect()
    x, y = np.array([r.x for r in rows]), np.array([r.y for r in rows])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    got = stacked.fit(data, "x", "y", None, [stacked.Fit(0.1, 0.0)])[0]
    p = 1 / (1 + np.exp(-(x @ got[:-1] + got[-1])))
    mean = (w[:, None] * x).sum(0) / w.sum()
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w**2).sum() / w.sum()))
    g = (w * (p - y)) @ x / w.sum() + 0.1 * got[:-1] * sd**2
    assert np.abs(g[sd > 0]).max() < 1e-8 and abs((w * (p - y)).sum()) < 1e-6 and got[5] == 0


def test_search_shared_and_separate(data):
    folds = split.group_kfold(data, "y", "g", 3, 2)
    grid = [{"regParam": 0.01}, {"regParam": 0.3, "elasticNetParam": 0.5}]
    args = (data, "logreg_l2", grid, folds, "g", "x", "y", 2)
    one, other = (sorted(map(tuple, f(*args).collect())) for f in (models._shared_search, models._separate_search))
    assert [r[:4] for r in one] == [r[:4] for r in other] and len(one) == 12
    assert all(abs(a - b) < 0.02 for r, s in zip(one, other) for a, b in zip(r[4:], s[4:]))
    model, results = models.cv_search(data, "logreg_l2", grid, folds, "g", "x", "y")
    assert sorted(map(tuple, results.collect())) == one and model.coefficients.size == 6


def test_class_weights_are_those_of_the_training_rows(data, monkeypatch):
    seen = []
    plain = models.weighted
    monkeypatch.setattr(models, "weighted", lambda d: seen.append(d.count()) or plain(d))
    folds = split.group_kfold(data, "y", "g", 3, 1)
    models._separate_search(data, "tree", [{}], folds, "g", "x", "y", 1)
    assert len(seen) == 3 and max(seen) < 240 and sum(seen) == 480


def test_no_rows(data):
    assert stacked.fit(data.where("false"), "x", "y", "f", FITS).shape == (27, 1)
