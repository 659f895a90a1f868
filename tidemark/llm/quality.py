"""Quality classifier by co-training a text-content view and a page-metadata view."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read_table
from tidemark.llm.textarrays import column, hash_words, release, windows

#: Labelled rows used for fitting and calibration, at most (the smallest by hash of doc_id).
LABELLED_ROWS = 40_000
ROUNDS = 3
#: Share of the unlabelled documents that each view is surest of, on either side, and so gives to the other view.
CONFIDENT = 0.02
#: What a class's pseudo-labels weigh together, at most, as a share of its labels.
PSEUDO_WEIGHT = 0.2
#: Steps of one fit, at most, and its tolerance.
STEPS, TOLERANCE = 25, 1e-6
#: Rows scored together, and rows of a fit that one task holds.
ROWS, FIT_ROWS = 1000, 20_000
#: Slots for hashed words of the text.
WORDS = 256
#: Slots for hashed source and language names.
SLOTS = 48
THRESHOLD = 0.5
#: Bytes looked at together.
PIECE = 1 << 20

#: Classes of bytes whose shares are features.
_CLASSES = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "white": [9, 10, 11, 12, 13, 32], "stop": [44, 46], "pipe": [124],
    "bang": [33, 63], "symbol": [35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 92, 94, 95, 96, 123, 125, 126], "wide": range(128, 256), "line": [10],
}
TEXT_FEATURES = [*_CLASSES, "log_words", "word_length", "distinct", "repeated", "cycle", "symbol_words", "bang_words", "pipe_words", "empty"]


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each whole text TEXT_FEATURES and the root of each word slot's share in 255ths; about PIECE bytes are looked at together."""
    edges = np.unique(np.concatenate(([0], np.searchsorted(offsets, np.arange(PIECE, len(data), PIECE)), [len(offsets) - 1])))
    parts = [_features(data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a]) for a, b in zip(edges, edges[1:])]
    return np.concatenate([np.zeros((0, len(TEXT_FEATURES) + WORDS), np.float32), *parts])


def _features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(offsets) - 1, len(TEXT_FEATURES)))
    size = np.maximum(np.diff(offsets), 1)
    for k, values in enumerate(_CLASSES.values()):
        table = np.zeros(256, bool)
        table[list(values)] = True
        sums = np.concatenate(([0], np.cumsum(table[data], dtype=np.int64)))
        out[:, k] = sums[offsets[1:]] - sums[offsets[:-1]]
    hashes, counts = hash_words(data, offsets)
    words = np.maximum(counts, 1)
    ends = np.cumsum(counts)
    k = len(_CLASSES)
    names = list(_CLASSES)
    out[:, k + 5] = out[:, names.index("symbol")] / words
    out[:, k + 6] = out[:, names.index("bang")] / words
    out[:, k + 7] = out[:, names.index("pipe")] / words
    out[:, :k] /= size[:, None]
    out[:, k], out[:, k + 1] = np.log1p(counts), np.minimum(np.diff(offsets) / words, 50) / 10
    same = np.concatenate(([0], np.cumsum(hashes[1:] == hashes[:-1]), [0]))
    grams, _ = windows(hashes, counts, 3)
    gram_ends = np.cumsum(np.maximum(counts - 2, 0))
    for i, c in enumerate(counts):
        if c > 2:
            a, b = ends[i] - c, ends[i]
            out[i, k + 2] = len(np.unique(hashes[a:b])) / c
            out[i, k + 3] = (same[b - 1] - same[a]) / c
            out[i, k + 4] = 1 - len(np.unique(grams[gram_ends[i] - c + 2 : gram_ends[i]])) / (c - 2)
        else:
            out[i, k + 2] = 1
    out[:, k + 8] = counts == 0
    slot = np.repeat(np.arange(len(counts)), counts) * WORDS + (hashes % np.uint64(WORDS)).astype(np.int64)
    share = np.bincount(slot, minlength=len(counts) * WORDS).reshape(len(counts), WORDS) / words[:, None]
    return np.hstack((out, np.rint(255 * np.sqrt(share)) / 255)).astype(np.float32)


def meta_features() -> Column:
    """Hashed source and language, and length, as one array; nulls have slots of their own."""
    slots = F.sequence(F.lit(0), F.lit(SLOTS - 1))
    slot = lambda c, salt: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit(salt)), F.lit(SLOTS))
    size = F.log1p(F.greatest(F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)), F.lit(0.0)))
    hot = F.transform(slots, lambda i: F.when(i == slot("source", 1), 1.0).otherwise(0.0) + F.when(i == slot("lang", 2), 1.0).otherwise(0.0))
    return F.concat(hot, F.array(size / 10, size * size / 100))


@dataclass
class View:
    """A linear classifier and its calibration: chance of good = sigmoid(a * margin + b)."""

    weights: np.ndarray
    bias: float
    a: float = 1.0
    b: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * (x @ self.weights + self.bias) + self.b, -30, 30)


@dataclass
class Model:
    """Both views and how their calibrated logits combine; views is empty where there was nothing to learn.

    taught: (round, teacher, class, documents, weight together) of each set of pseudo-labels that was given.
    """

    views: list[View]
    mix: np.ndarray
    prior: float
    taught: list[tuple[int, str, int, int, float]] = field(default_factory=list)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, none below 0, and bias of a small logistic fit by Newton steps.

    Weights of the scaled columns are held back by a ridge: with few rows a column must be very telling to
    count, with many the ridge doesn't matter. Targets are drawn in from 0 and 1 as if each class held one row
    of the other, so that rows which a view tells apart without fault still have a best fit. A view may say
    nothing, never the contrary: a column whose weight is below 0 is left out and the others, the bias too, are fitted anew.
    """
    w = _fit(x, y, ridge)
    if x.shape[1] and w[:-1].min() < 0:
        worst = int(w[:-1].argmin())
        w = np.insert(_calibrate(np.delete(x, worst, axis=1), y, ridge), worst, 0.0)
    return w


def _fit(x: np.ndarray, y: np.ndarray, ridge: float) -> np.ndarray:
    """The fit of _calibrate, weights of either sign; a column that is constant but for rounding gets none."""
    good = y.sum()
    y = np.where(y > 0, (good + 1) / (good + 2), 1 / (len(y) - good + 2))
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-9 * (1 + np.abs(mean)), scale, np.inf)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w, hold = np.zeros(z.shape[1]), ridge * np.append(np.ones(x.shape[1]), 1e-6)
    loss = lambda v: (np.logaddexp(0, z @ v) - y * (z @ v)).sum() + (hold * v * v).sum() / 2
    for _ in range(50):
        p = _sigmoid(z @ w)
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(hold)
        step = np.linalg.solve(h, z.T @ (y - p) - hold * w)
        size, now = 1.0, loss(w)
        while size > 1e-9 and loss(w + size * step) > now:  # a whole step may overshoot where all chances are near 0 or 1
            size /= 2
        w += size * step
        if np.abs(step).max() < 1e-8:
            break
    w[:-1] /= scale
    w[-1] -= w[:-1] @ mean
    return w


VIEWS = ("text", "meta")


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float)


def featured(docs: DataFrame) -> DataFrame:
    """doc_id and both views' features (text_x, meta_x) of every document."""

    @F.arrow_udf("array<float>")
    def content(texts: pa.Array) -> pa.Array:
        flat = np.concatenate([np.zeros((0, len(TEXT_FEATURES) + WORDS), np.float32), *(text_features(*column(texts.slice(k, ROWS))) for k in range(0, len(texts), ROWS))])
        release()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * flat.shape[1], pa.int32()), pa.array(flat.ravel()))

    return docs.select("doc_id", content(F.col("text").cast("binary")).alias("text_x"), meta_features().cast("array<float>").alias("meta_x"))


def _logits(views: list[View]) -> Column:
    """A struct of both views' logits; a batch of rows is one matrix a view."""

    @F.arrow_udf("text double, meta double")
    def work(text: pa.Array, meta: pa.Array) -> pa.Array:
        xs = [c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), len(v.weights)) for v, c in zip(views, (text, meta))]
        parts = [[v.logit(x[k : k + ROWS].astype(float)) for k in range(0, len(x), ROWS)] for v, x in zip(views, xs)]
        return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0), *p])) for p in parts], list(VIEWS))

    return work(*[F.col(f"{v}_x") for v in VIEWS])


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, labelled_rows: int = LABELLED_ROWS) -> Model:
    """Co-train on labelled rows and on the pseudo-labels that each view gives the other from all unlabelled documents.

    Labels: (doc_id, quality 0/1); null labels and labels without a document are left out, a doc_id
    labelled twice counts by its smallest label, and a document that has rows more than once by one of
    them. Of more labels than labelled_rows those with the smallest hashes count; the other documents are
    unlabelled ones here. One labelled row in four (by hash) only calibrates.
    The first round fits both views on the labels. In each further one a view gives the other the CONFIDENT
    share of the unlabelled documents with its highest chances as good and that with its lowest ones as
    bad. How right such choices are is measured on the calibrating rows: they weigh 2 * precision - 1 (with
    one right and one wrong row added), so a view that chooses at random, or on no evidence, teaches
    nothing. Ends early where the choices don't change any more.
    """
    given = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").cast("double").alias("y"))
    given = given.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("h", F.xxhash64("doc_id"))
    n = given.count()
    if n > labelled_rows:  # hashes are even, so this leaves little more than is wanted
        given = given.where(F.col("h") < int(-(2**63) + 2**64 * min(0.999, 1.1 * labelled_rows / n)))
    chosen = materialize(given.orderBy("h", "doc_id").limit(labelled_rows).select("doc_id", "y"), "chosen")  # labelled_rows at most
    table = materialize(featured(docs).join(F.broadcast(chosen), "doc_id", "left"), "features")
    known = table.where("y is not null").dropDuplicates(["doc_id"])
    known = materialize(known.withColumn("test", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0), "labelled")
    sums = known.agg(F.count("*"), F.sum("y"), F.sum(F.when(F.col("test"), F.col("y"))), F.sum(F.col("test").cast("int"))).first()
    prior = (sums[1] or 0) / sums[0] if sums[0] else 1.0
    if not sums[0] or not 0 < (sums[2] or 0) < (sums[3] or 0) or not 0 < sums[1] - sums[2] < sums[0] - sums[3]:
        return Model([], np.zeros(3), prior)
    held = known.where("test").select("text_x", "meta_x", "y").toPandas()  # bounded by labelled_rows
    xs = [_matrix(held[f"{v}_x"]) for v in VIEWS]
    y = held["y"].to_numpy()
    fit = known.where("not test").select("text_x", "meta_x", "y", F.lit(1.0).alias("w"))
    labelled = {1: sums[1] - sums[2], 0: sums[0] - sums[3] - (sums[1] - sums[2])}
    pool = table.where("y is null").select("text_x", "meta_x")
    learner = LogisticRegression(featuresCol="x", labelCol="y", weightCol="w", maxIter=STEPS, tol=TOLERANCE, regParam=max(1e-4, 0.5 / sums[0]))
    views: list[View] = []
    taught, before = [], None
    for k in range(rounds):
        lessons: list[DataFrame | None] = [None, None]
        more = [0, 0]
        if views:
            guessed = pool.withColumn("l", _logits(views))
            ends = guessed.agg(*[F.percentile_approx(f"l.{v}", F.array(F.lit(CONFIDENT), F.lit(1 - CONFIDENT)), F.lit(10_000)) for v in VIEWS]).first()
            chosen = {(v, c): (F.col(f"l.{v}") >= e[1] if c else F.col(f"l.{v}") <= e[0]) for v, e in zip(VIEWS, ends) if e and e[0] < e[1] for c in (1, 0)}
            numbers = guessed.agg(*[F.count_if(c) for c in chosen.values()]).first() if chosen else []
            if before == (ends, numbers):
                break
            before = (ends, numbers)
            given: list[Column] = []
            for t, v in enumerate(VIEWS):
                said, weight = views[t].logit(xs[t]), {}
                for (name, c), n in zip(chosen, numbers):
                    if name == v:
                        right = (y == c)[said >= ends[t][1] if c else said <= ends[t][0]]
                        together = PSEUDO_WEIGHT * labelled[c] * max(0.0, 2 * (right.sum() + 1) / (len(right) + 2) - 1)
                        if n and together:
                            weight[c] = together / n
                            more[1 - t] += n
                            taught.append((k, v, c, int(n), together))
                lesson = [F.when(chosen[v, c], F.struct(F.lit(float(c)).alias("y"), F.lit(float(w)).alias("w"))) for c, w in weight.items()]
                given.append(F.coalesce(*lesson, F.lit(None).cast("struct<y:double,w:double>")).alias(f"{v}_says"))
            # Written once: a fit then reads few small files in each step, not a task for each part of all documents.
            told = materialize(guessed.select("text_x", "meta_x", *given).where("text_says is not null or meta_says is not null"), "lessons")
            for t, v in enumerate(VIEWS):
                lessons[1 - t] = told.where(f"{v}_says is not null").select("text_x", "meta_x", f"{v}_says.y", f"{v}_says.w")
        new = []
        for t, v in enumerate(VIEWS):
            rows = fit.unionByName(lessons[t]) if lessons[t] is not None else fit
            rows = rows.coalesce(1 + (sums[0] + more[t]) // FIT_ROWS)  # each step is a job, whose tasks cost more than few rows
            m = learner.fit(rows.select(array_to_vector(F.col(f"{v}_x").cast("array<double>")).alias("x"), "y", "w"))
            view = View(np.asarray(m.coefficients), float(m.intercept))
            view.a, view.b = _calibrate((xs[t] @ view.weights + view.bias)[:, None], y).tolist()
            new.append(view)
        views = new
    logits = np.column_stack([v.logit(x) for v, x in zip(views, xs)])
    return Model(views, _calibrate(logits, y), prior, taught)


_SCORES = "text_score double, meta_score double, score double, keep boolean"


def score(model: Model, threshold: float = THRESHOLD) -> Column:
    """A struct of calibrated chances of good quality by each view and together, and whether to keep the document."""

    @F.arrow_udf(_SCORES)
    def work(texts: pa.Array, metas: pa.Array) -> pa.Array:
        names, n = [c.split()[0] for c in _SCORES.split(", ")], len(texts)
        if not model.views:
            p = pa.array(np.full(n, model.prior))
            return pa.StructArray.from_arrays([p, p, p, pa.array(np.ones(n, bool))], names)
        a, b = np.zeros(n), np.zeros(n)
        meta = metas.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
        for k in range(0, n, ROWS):  # the features of a batch together would take as much as its texts
            some = slice(k, k + ROWS)
            a[some] = model.views[0].logit(text_features(*column(texts.slice(k, ROWS))))
            b[some] = model.views[1].logit(meta[some].astype(float))
        both = _sigmoid(a * model.mix[0] + b * model.mix[1] + model.mix[2])
        release()
        return pa.StructArray.from_arrays([pa.array(_sigmoid(a)), pa.array(_sigmoid(b)), pa.array(both), pa.array(both >= threshold)], names)

    return work(F.col("text").cast("binary"), meta_features().cast("array<float>"))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Every document with text_score, meta_score, score and keep, all its own columns before them.

    A null or empty text has the feature `empty`; null lang, source and n_chars count as "" and 0. With no
    labels, or labels of one class only, every document is kept and its score is the share of good labels
    (1 without any). Repeated rows get equal scores; an empty table gives an empty result. Columns of the
    input that are named like a score are replaced.
    """
    return scored_by(docs, train(docs, labels))


def scored_by(docs: DataFrame, model: Model) -> DataFrame:
    """docs with the model's scores, as classify gives them."""
    aside = "_quality"
    while aside in {c.lower() for c in docs.columns}:
        aside += "_"
    names = [x.split()[0] for x in _SCORES.split(", ")]
    return docs.withColumn(aside, score(model)).withColumns({c: F.col(aside)[c] for c in names}).drop(aside)


def op8_cotrained_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return classify(docs, read_table(spark, sf_dir, "labels")).select("doc_id", "text_score", "meta_score", "score", "keep")
