"""Classifiers on window features: training, search, evaluation and thresholds."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Model
from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LinearSVC, LogisticRegression, RandomForestClassifier
from pyspark.ml.regression import LinearRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranged import running_sums
from tidemark.operators import stacked
from tidemark.operators.neighbours import knn_join  # noqa: F401
from tidemark.operators.split import group_kfold


def estimator(kind: str, seed: int = 42, **params) -> Estimator:
    """One of: logreg_l1, logreg_l2, tree, forest, gbt, svc, ridge (least squares on the labels with an L2 penalty; above 1/2 is 1)."""
    base = {"featuresCol": "_x", "labelCol": "_y"}
    if kind in ("logreg_l1", "logreg_l2"):
        return LogisticRegression(**base, weightCol="_w", **({"regParam": 0.01, "maxIter": 50, "elasticNetParam": float(kind == "logreg_l1")} | params))
    if kind == "tree":
        return DecisionTreeClassifier(**base, seed=seed, weightCol="_w", **params)
    if kind == "forest":
        return RandomForestClassifier(**base, seed=seed, weightCol="_w", **({"numTrees": 20} | params))
    if kind == "gbt":
        return GBTClassifier(**base, seed=seed, weightCol="_w", **({"maxIter": 10} | params))
    if kind == "svc":
        return LinearSVC(**base, weightCol="_w", **({"regParam": 0.01, "maxIter": 30} | params))
    if kind == "ridge":
        return LinearRegression(**base, weightCol="_w", elasticNetParam=0.0, **({"regParam": 0.1} | params))
    raise ValueError(f"no such model: {kind}")


def prepared(df: DataFrame, x: str, y: str) -> DataFrame:
    """Adds the vector, label and class-balancing weight n / (2 n_c) that estimators read; to be called on training rows only."""
    return weighted(df.withColumns({"_x": array_to_vector(F.col(x).cast("array<double>")), "_y": F.col(y).cast("double")}))


def weighted(d: DataFrame) -> DataFrame:
    counts = d.groupBy("_y").agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_n"))
    weights = counts.join(F.broadcast(total)).select("_y", (F.col("_n") / (2 * F.col("_c"))).alias("_w"))
    return d.join(F.broadcast(weights), "_y")


def scored(model: Model, df: DataFrame) -> DataFrame:
    """Adds score (probability of class 1, or the margin) and yhat."""
    out = model.transform(df)
    if "rawPrediction" not in out.columns:
        return out.withColumn("score", F.col("prediction")).withColumn("yhat", (F.col("score") >= 0.5).cast("int"))
    if "probability" in out.columns:
        return out.withColumn("score", vector_to_array("probability")[1]).withColumn("yhat", (F.col("score") >= 0.5).cast("int"))
    return out.withColumn("score", vector_to_array("rawPrediction")[1]).withColumn("yhat", (F.col("score") >= 0).cast("int"))


def confusion(df: DataFrame, y: str = "y", yhat: str = "yhat") -> DataFrame:
    """y, yhat, n and share of all rows."""
    counts = df.groupBy(y, yhat).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_n"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_n")).drop("_n")


def roc_auc(df: DataFrame, score: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Exact area under the curve by ranks with ties at their mean.

    Scores are counted first, so the running sums go over distinct scores of a group, in ranges: each range's
    counts are carried in one row, and no task orders all rows.
    """
    by = by or []
    counts = df.groupBy(*by, F.col(score).alias("_s")).agg(F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) == 0).cast("long")).alias("_q"))
    below = running_sums(counts, "_s", ["_q"], by)
    agg = below.groupBy(*by).agg(F.sum(F.col("_p") * (F.col("below__q") + F.col("_q") / 2)).alias("_u"), F.sum("_p").alias("n_pos"), F.sum("_q").alias("n_neg"))
    return agg.withColumn("auc", F.try_divide("_u", F.col("n_pos") * F.col("n_neg"))).drop("_u")


def balanced_accuracy(df: DataFrame, y: str = "y", yhat: str = "yhat", by: list[str] | None = None) -> DataFrame:
    """Mean over classes of the share found."""
    by = by or []
    recall = df.groupBy(*by, F.col(y).alias("_c")).agg(F.avg((F.col(y) == F.col(yhat)).cast("double")).alias("_r"))
    return recall.groupBy(*by).agg(F.avg("_r").alias("balanced_accuracy"))


def best_threshold(df: DataFrame, score: str, y: str) -> DataFrame:
    """threshold, balanced_accuracy: of all distinct scores, the cut (score >= it is 1) with the best balance; ties to the lowest.

    Counts by distinct score first; running sums over those.
    """
    counts = df.groupBy(F.col(score).alias("threshold")).agg(F.sum((F.col(y) == 1).cast("long")).alias("_p"), F.sum((F.col(y) == 0).cast("long")).alias("_q"))
    run = running_sums(counts, "threshold", ["_p", "_q"])
    value = (F.try_divide(F.col("all__p") - F.col("below__p"), F.col("all__p")) + F.try_divide("below__q", F.col("all__q"))) / 2
    best = run.withColumn("balanced_accuracy", F.round(value, 12)).agg(F.max(F.struct("balanced_accuracy", (-F.col("threshold")).alias("t"))).alias("b"))
    return best.select((-F.col("b.t")).alias("threshold"), F.col("b.balanced_accuracy").alias("balanced_accuracy"))


def evaluate(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """auc and balanced_accuracy of rows with score, yhat and _y."""
    a = roc_auc(df, "score", "_y", by).select(*(by or []), "auc")
    b = balanced_accuracy(df, "_y", "yhat", by)
    return a.join(b, by) if by else a.join(F.broadcast(b))


_METRICS = ["auc", "balanced_accuracy"]
_RESULTS = "setting int, params string, repeat int, fold int, train_auc double, val_auc double, train_balanced_accuracy double, val_balanced_accuracy double"


def cv_search(df: DataFrame, kind: str, grid: list[dict], folds: DataFrame, group: str, x: str, y: str, rank: str = "auc", parallelism: int = 4) -> tuple[Model, DataFrame]:
    """Fits every setting on every fold; the best setting refitted on all rows, and a row of metrics for each setting and fold.

    Logistic regressions (up to stacked.WIDEST features) are fitted and scored all together, each pass over
    the rows serving every setting and fold; other kinds one by one, `parallelism` at a time. Classes are balanced within
    the training rows of each fit.
    """
    shared = kind.startswith("logreg") and all(set(p) <= {"regParam", "elasticNetParam"} for p in grid)
    shared = shared and (df.select(F.max(F.size(x))).first()[0] or 0) <= stacked.WIDEST
    results = (_shared_search if shared else _separate_search)(df, kind, grid, folds, group, x, y, parallelism)
    rows = results.collect()  # a row a setting and fold
    mean = {i: [r[f"val_{rank}"] for r in rows if r["setting"] == i and r[f"val_{rank}"] is not None] for i in range(len(grid))}
    best = max(mean, key=lambda i: (sum(mean[i]) / len(mean[i]) if mean[i] else -1, -i))
    return estimator(kind, **grid[best]).fit(prepared(df, x, y)), df.sparkSession.createDataFrame(rows, _RESULTS)


def _shared_search(df: DataFrame, kind: str, grid: list[dict], folds: DataFrame, group: str, x: str, y: str, parallelism: int) -> DataFrame:
    repeats = folds.agg(F.max("repeat")).first()[0] + 1
    of_group = folds.groupBy(group).agg(*[F.max(F.when(F.col("repeat") == r, F.col("fold"))).alias(f"_f{r}") for r in range(repeats)])
    data = df.select(group, F.col(x).alias("_x"), F.col(y).cast("int").alias("_y")).join(of_group, group)
    data = data.select("_x", "_y", F.array(*[f"_f{r}" for r in range(repeats)]).alias("_f")).persist()
    pairs = [tuple(r) for r in folds.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]  # repeats * k rows
    base = {"regParam": 0.01, "elasticNetParam": float(kind == "logreg_l1")}
    jobs = [(i, repeat, fold) for i in range(len(grid)) for repeat, fold in pairs]
    fits = [stacked.Fit(**(base | grid[i]), repeat=repeat, fold=fold) for i, repeat, fold in jobs]
    found = stacked.scores(data, "_x", stacked.fit(data, "_x", "_y", "_f", fits))
    each = found.select("_y", "_f", F.posexplode("scores").alias("fit", "score"))
    named = df.sparkSession.createDataFrame([(n, i, str(sorted(grid[i].items())), repeat, fold) for n, (i, repeat, fold) in enumerate(jobs)], "fit int, setting int, params string, repeat int, fold int")
    told = each.join(F.broadcast(named), "fit").withColumns({"part": F.when(F.get("_f", F.col("repeat")) == F.col("fold"), "val").otherwise("train"), "yhat": (F.col("score") >= 0.5).cast("int")})
    by = ["fit", "part"]
    metrics = roc_auc(told, "score", "_y", by).select(*by, "auc").join(balanced_accuracy(told, "_y", "yhat", by), by)
    picked = [F.max(F.when(F.col("part") == p, F.col(m))).alias(f"{p}_{m}") for m in _METRICS for p in ("train", "val")]
    rows = metrics.groupBy("fit").agg(*picked).join(F.broadcast(named), "fit").select("setting", "params", "repeat", "fold", *[f"{p}_{m}" for m in _METRICS for p in ("train", "val")]).collect()
    data.unpersist()
    return df.sparkSession.createDataFrame(sorted(rows, key=lambda r: (r["setting"], r["repeat"], r["fold"])), _RESULTS)


def _separate_search(df: DataFrame, kind: str, grid: list[dict], folds: DataFrame, group: str, x: str, y: str, parallelism: int) -> DataFrame:
    data = df.withColumns({"_x": array_to_vector(F.col(x).cast("array<double>")), "_y": F.col(y).cast("double")}).join(folds.select(group, "repeat", "fold"), group)
    data = data.select("_x", "_y", "repeat", "fold").persist()
    pairs = [tuple(r) for r in data.select("repeat", "fold").distinct().orderBy("repeat", "fold").collect()]  # repeats * k rows

    def one(job: tuple[int, dict, tuple[int, int]]) -> tuple:
        setting, params, (repeat, fold) = job
        mine = data.where(F.col("repeat") == repeat)
        model = estimator(kind, **params).fit(weighted(mine.where(F.col("fold") != fold)))
        out = scored(model, mine).withColumn("part", F.when(F.col("fold") == fold, "val").otherwise("train"))
        m = {r["part"]: r for r in evaluate(out, ["part"]).collect()}
        get = lambda p, c: float(m[p][c]) if p in m and m[p][c] is not None else None
        return (setting, str(sorted(params.items())), repeat, fold, *[get(p, c) for c in _METRICS for p in ("train", "val")])

    with ThreadPoolExecutor(parallelism) as pool:
        rows = list(pool.map(one, [(i, p, pair) for i, p in enumerate(grid) for pair in pairs]))
    data.unpersist()
    return df.sparkSession.createDataFrame(rows, _RESULTS)


def random_settings(space: dict[str, tuple], n: int, seed: int = 42) -> list[dict]:
    """n settings drawn from a space: name -> ("choice", values), ("uniform", lo, hi[, step]), ("loguniform", lo, hi),
    ("randint", lo, hi[, step]) or ("lograndint", lo, hi); hi of the integer kinds isn't drawn."""
    import math
    import random

    rng = random.Random(seed)

    def draw(kind: str, *a):
        if kind == "choice":
            return rng.choice(list(a[0]))
        value = math.exp(rng.uniform(math.log(a[0]), math.log(a[1]))) if kind.startswith("log") else rng.uniform(a[0], a[1])
        if len(a) > 2:
            value = round(value / a[2]) * a[2]
        if kind in ("randint", "lograndint"):
            return min(max(int(value), a[0]), a[1] - 1) if len(a) < 3 else int(value)
        if kind not in ("uniform", "loguniform"):
            raise ValueError(f"no such distribution: {kind}")
        return value

    return [{name: draw(*d) for name, d in space.items()} for _ in range(n)]


def search_summary(results: DataFrame) -> DataFrame:
    """Mean and population deviation over all folds, and the gap from train to validation, of both metrics, for each setting."""
    out = []
    for m in ("auc", "balanced_accuracy"):
        for part in ("train", "val"):
            out += [F.avg(f"{part}_{m}").alias(f"mean_{part}_{m}"), F.stddev_pop(f"{part}_{m}").alias(f"std_{part}_{m}")]
        out.append((F.avg(f"train_{m}") - F.avg(f"val_{m}")).alias(f"gap_{m}"))
    return results.groupBy("setting", "params").agg(F.count("*").alias("folds"), *out)


def holdout_confusion(df: DataFrame, kind: str, group: str, x: str, y: str, seed: int = 42) -> DataFrame:
    """Confusion matrix of a fit on one half of the groups, on the other half."""
    folds = group_kfold(df, y, group, 2, 1, seed).select(group, "fold")
    data = df.withColumns({"_x": array_to_vector(F.col(x).cast("array<double>")), "_y": F.col(y).cast("double")}).join(folds, group)
    model = estimator(kind, seed).fit(weighted(data.where("fold = 0")))
    return confusion(scored(model, data.where("fold = 1")).withColumn("_y", F.col("_y").cast("int")), "_y", "yhat").withColumnRenamed("_y", "y")


def knn_vote(near: DataFrame, qid: str, weights: str = "uniform") -> DataFrame:
    """qid, yhat: the label with the most votes (or the largest sum of 1 / distance); ties to the smaller label."""
    vote = F.sum(F.lit(1.0) if weights == "uniform" else 1 / F.greatest(F.col("distance"), F.lit(1e-12)))
    votes = near.groupBy(qid, "label").agg(vote.alias("v"))
    return votes.groupBy(qid).agg(F.max(F.struct("v", (-F.col("label")).alias("l"))).alias("b")).select(qid, (-F.col("b.l")).alias("yhat"), F.col("b.v").alias("votes"))
