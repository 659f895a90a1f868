"""What the fitted models say, worked out again in numpy: optima, splits, votes, margins and metrics."""

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import models
from tidemark.plans import matrix
from tidemark.sources import tables


@pytest.fixture(scope="module")
def small(spark):
    rng = np.random.default_rng(12)
    x = np.round(rng.normal(size=(160, 4)), 1)
    y = (x[:, 1] > 0.25).astype(int) ^ (rng.random(160) < 0.1)
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y))], "id int, x array<double>, y int").coalesce(1).cache()
    return df, x, y, np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))


def auc(score, y):
    """Share of (positive, negative) pairs in the right order, ties half."""
    p, n = score[y == 1], score[y == 0]
    return ((p[:, None] > n).sum() + (p[:, None] == n).sum() / 2) / (len(p) * len(n))


def balance(yhat, y):
    return np.mean([(yhat[y == c] == c).mean() for c in (0, 1)])


@pytest.mark.parametrize("kind,params,query", [("tree", {}, "train_tree"), ("forest", {"numTrees": 10}, "train_forest"), ("gbt", {"maxIter": 5}, "train_gbt"), ("svc", {}, "linear_svc"), ("logreg_l2", {}, "score_and_evaluate"), ("logreg_l1", {"regParam": 0.02}, "score_and_evaluate")])
def test_queries_report_what_the_model_scores(spark, sf_dir, kind, params, query):
    v = tables.vectors(spark, sf_dir).withColumn("y", (F.col("label") % 2).cast("int"))
    model = models.estimator(kind, **params).fit(models.prepared(v.where("id % 5 != 0"), "x", "y"))
    out = models.scored(model, v.where("id % 5 = 0").withColumns({"_x": array_to_vector("x")})).select("score", "yhat", "y").toPandas()
    (row,) = [r for r in getattr(matrix, query)(spark, sf_dir).collect() if r.model == kind]
    y = out["y"].to_numpy()
    assert abs(row.auc - auc(out["score"].to_numpy(), y)) < 2e-6 and abs(row.balanced_accuracy - balance(out["yhat"].to_numpy(), y)) < 2e-6


def test_a_stump_splits_where_impurity_falls_most(small):
    df, x, y, w = small
    tree = models.estimator("tree", maxDepth=1, maxBins=200).fit(models.prepared(df, "x", "y"))
    gini = lambda m: 0.0 if not w[m].sum() else w[m].sum() * (1 - sum((w[m & (y == c)].sum() / w[m].sum()) ** 2 for c in (0, 1)))
    best = min((gini(x[:, j] <= t) + gini(x[:, j] > t), j, t) for j in range(4) for t in np.unique(x[:, j])[:-1])
    got = {r.id: r.prediction for r in tree.transform(models.prepared(df, "x", "y")).collect()}
    side = x[:, best[1]] <= best[2]
    for part in (side, ~side):
        assert {got[i] for i in np.flatnonzero(part)} == {float(w[part & (y == 1)].sum() > w[part & (y == 0)].sum())}


def test_forests_and_boosted_trees_add_up(small):
    df, *_ = small
    data = models.prepared(df, "x", "y").select("id", "_x", "_y", "_w").cache()
    forest = models.estimator("forest", numTrees=7).fit(data)
    votes = np.mean([[np.array(r.probability) for r in t.setFeaturesCol("_x").transform(data).orderBy("id").collect()] for t in forest.trees], axis=0)
    assert np.allclose(votes, [np.array(r.probability) for r in forest.transform(data).orderBy("id").collect()])
    boosted = models.estimator("gbt", maxIter=4).fit(data)
    margin = sum(w * np.array([r.prediction for r in t.setFeaturesCol("_x").setPredictionCol("prediction").transform(data).orderBy("id").collect()]) for t, w in zip(boosted.trees, boosted.treeWeights))
    assert np.allclose(1 / (1 + np.exp(-2 * margin)), [r.probability[1] for r in boosted.transform(data).orderBy("id").collect()])


def test_ridge_in_closed_form(small):
    """Least squares with a penalty on coefficients of features scaled to deviation 1, targets too."""
    df, x, y, w = small
    model = models.estimator("ridge", regParam=0.1).fit(models.prepared(df, "x", "y"))
    mean, target = (w[:, None] * x).sum(0) / w.sum(), (w * y).sum() / w.sum()
    spread = lambda v, m: np.sqrt((w * (v - m) ** 2).sum() / w.sum())
    sd, sy = np.array([spread(x[:, j], mean[j]) for j in range(4)]), spread(y, target)
    z, t = (x - mean) / sd, (y - target) / sy
    b = np.linalg.solve((z * w[:, None]).T @ z / w.sum() + 0.1 / sy * np.eye(4), (z * w[:, None]).T @ t / w.sum()) * sy / sd
    assert np.allclose(model.coefficients.toArray(), b, atol=1e-6) and abs(model.intercept - (target - mean @ b)) < 1e-6


def test_svc_is_at_its_optimum(small):
    """No direction lowers the penalized hinge loss."""
    df, x, y, w = small
    model = models.estimator("svc", maxIter=500, tol=1e-12).fit(models.prepared(df, "x", "y"))
    mean = (w[:, None] * x).sum(0) / w.sum()
    sd = np.sqrt((w[:, None] * (x - mean) ** 2).sum(0) / (w.sum() - (w**2).sum() / w.sum()))
    loss = lambda b, c: (w * np.maximum(0, 1 - (2 * y - 1) * (x @ b + c))).sum() / w.sum() + 0.01 / 2 * ((b * sd) ** 2).sum()
    b, c = model.coefficients.toArray(), model.intercept
    rng, here = np.random.default_rng(1), loss(b, c)
    tried = [loss(b + s * d[:4], c + s * d[4]) for s in (1e-3, 1e-2, 0.1, 1) for d in rng.normal(size=(200, 5))]
    assert here <= min(tried) + 1e-3 and here < loss(0 * b, 0.0)


def test_confusion_and_threshold(small, spark):
    df, x, y, _ = small
    scored = df.select("y", F.get("x", F.lit(1)).alias("score")).withColumn("yhat", (F.col("score") >= 0.3).cast("int"))
    got = {(r.y, r.yhat): (r.n, r.share) for r in models.confusion(scored).collect()}
    yhat = (x[:, 1] >= 0.3).astype(int)
    assert got == {(a, b): (n, n / 160) for a in (0, 1) for b in (0, 1) if (n := int(((y == a) & (yhat == b)).sum()))}
    best = max((round(balance((x[:, 1] >= t).astype(int), y), 12), -t) for t in np.unique(x[:, 1]))
    row = models.best_threshold(scored, "score", "y").first()
    assert abs(row.threshold + best[1]) < 1e-12 and abs(row.balanced_accuracy - best[0]) < 1e-9
