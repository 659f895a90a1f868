"""Logistic regressions of many settings and folds fitted together: each pass over the rows serves all of them."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tree import added

#: Numbers of all fits' curvature that one pass gathers; more fits take turns.
HELD = 1 << 22
#: Widest features that are fitted this way.
WIDEST = 512


@dataclass(frozen=True)
class Fit:
    """Elastic net: regParam x (elasticNetParam x |b| + (1 - elasticNetParam) / 2 x |b|^2) on features scaled to deviation 1.

    Trained on rows whose fold in `repeat` isn't `fold`; None: on all rows.
    """

    regParam: float = 0.01
    elasticNetParam: float = 0.0
    repeat: int = 0
    fold: int | None = None

    def mask(self) -> tuple[int, int | None]:
        return (self.repeat, self.fold) if self.fold is not None else (0, None)


def _added(df: DataFrame) -> dict[int, np.ndarray]:
    """Sums of the arrays of each `what` over all tasks."""
    parts = df.withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33))
    return {r["what"]: np.frombuffer(r["value"], np.float64) for r in added(parts).collect()}


def _blocks(batches):
    """Features, labels and folds of some rows at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, 2048):
            part = batch.slice(at, 2048)
            wide = [part.column(c).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1) for c in (0, 2)]
            yield wide[0], part.column(1).to_numpy(), wide[1]


def _trained(folds: np.ndarray, masks: list[tuple[int, int | None]]) -> np.ndarray:
    return np.stack([np.ones(len(folds)) if fold is None else (folds[:, repeat] != fold).astype(float) for repeat, fold in masks], 1)


def _row(values: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"what": pa.array(range(len(values)), pa.int32()), "value": pa.array([np.ascontiguousarray(v).tobytes() for v in values], pa.binary())})


def _moments(rows: DataFrame, masks: list, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Class weights n / (2 n_c) by mask and class, and the weighted sample deviation of each feature by mask.

    First sums of counts, features and squares by mask and class; both follow from them on the driver.
    """

    def work(batches):
        n, s1, s2 = np.zeros((len(masks), 2)), np.zeros((len(masks), 2, width)), np.zeros((len(masks), 2, width))
        for x, y, folds in _blocks(batches):
            use = _trained(folds, masks)
            for c in (0, 1):
                u = use * (y == c)[:, None]
                n[:, c] += u.sum(0)
                s1[:, c] += u.T @ x
                s2[:, c] += u.T @ (x * x)
        yield _row([n, s1, s2])

    found = _added(rows.mapInArrow(work, "what int, value binary"))
    n, s1, s2 = found[0].reshape(-1, 2), found[1].reshape(-1, 2, width), found[2].reshape(-1, 2, width)
    with np.errstate(divide="ignore", invalid="ignore"):
        weight = np.where(n > 0, n.sum(1, keepdims=True) / (2 * n), 0.0)
        total, squares = (weight * n).sum(1), (weight**2 * n).sum(1)
        mean = (weight[:, :, None] * s1).sum(1) / total[:, None]
        spread = (weight[:, :, None] * s2).sum(1) - total[:, None] * mean**2
        deviation = np.sqrt(np.maximum(spread, 0) / (total - squares / total)[:, None])
    return weight, np.nan_to_num(deviation)


def _descend(g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: float, l2: float) -> np.ndarray:
    """The step that minimizes the quadratic model plus the penalty (the last coordinate is free of it), by coordinates."""
    step, slope, free = np.zeros(len(b)), g.copy(), len(b) - 1
    if l1 == 0:
        h2, g2 = h.copy(), g.copy()
        h2[np.arange(free), np.arange(free)] += l2
        g2[:free] += l2 * b[:free]
        return -np.linalg.lstsq(h2, g2, rcond=None)[0]
    for _ in range(1000):
        most = 0.0
        for j in range(len(b)):
            a, at = h[j, j], b[j] + step[j]
            if a <= 0:
                continue
            if j == free:
                new = at - slope[j] / a
            else:
                u = a * at - slope[j]
                new = np.sign(u) * max(abs(u) - l1, 0.0) / (a + l2)
            if new != at:
                slope += h[:, j] * (new - at)
                step[j] += new - at
                most = max(most, abs(new - at))
        if most < 1e-12:
            break
    return step


def fit(df: DataFrame, x: str, y: str, folds: str | None, fits: list[Fit], tolerance: float = 1e-9, passes: int = 60) -> np.ndarray:
    """Coefficients of every fit, intercept last, one row a fit, for raw features.

    df: rows with features x (array), label y (0 or 1) and folds (array of the row's fold in each repeat; None: no folds).
    Each pass gives all open fits' losses, gradients and curvatures at once; the driver takes each fit's
    proximal Newton step, and halves it where the loss didn't fall enough. Classes weigh the same in each fit's own training
    rows. A fit is done when its step is below tolerance. Features without deviation get 0.
    """
    fold = F.col(folds).cast("array<int>") if folds else F.array(F.lit(0))
    rows = df.select(F.col(x).cast("array<double>").alias("x"), F.col(y).cast("int").alias("y"), fold.alias("f")).where("x is not null and y is not null")
    first = rows.select(F.size("x")).first()
    width = first[0] if first else 0
    masks = list(dict.fromkeys(f.mask() for f in fits))
    out = np.zeros((len(fits), width + 1))
    if not width:
        return out
    weight, deviation = _moments(rows, masks, width)
    together = max(1, HELD // (width + 1) ** 2)
    for at in range(0, len(fits), together):
        out[at : at + together] = _newton(rows, fits[at : at + together], masks, weight, deviation, tolerance, passes)
    return out


def _newton(rows: DataFrame, fits: list[Fit], masks: list, weight: np.ndarray, deviation: np.ndarray, tolerance: float, passes: int) -> np.ndarray:
    width = deviation.shape[1]
    of = np.array([masks.index(f.mask()) for f in fits])
    scale = np.hstack([np.where(deviation[of] > 0, 1 / np.where(deviation[of] > 0, deviation[of], 1), 0), np.ones((len(fits), 1))])
    l1 = np.array([f.regParam * f.elasticNetParam for f in fits])
    l2 = np.array([f.regParam * (1 - f.elasticNetParam) for f in fits])
    penalty = lambda b, i: l1[i] * np.abs(b[:-1]).sum() + l2[i] / 2 * (b[:-1] ** 2).sum()
    at, step = np.zeros((len(fits), width + 1)), np.zeros((len(fits), width + 1))
    value, share, promise = np.full(len(fits), np.inf), np.ones(len(fits)), np.zeros(len(fits))
    open_ = np.arange(len(fits))
    for _ in range(passes):
        trial = at[open_] + share[open_, None] * step[open_]
        held = rows.sparkSession.sparkContext.broadcast((trial * scale[open_], of[open_], weight, masks))

        def work(batches, held=held):
            w, of, weight, masks = held.value
            m, d = w.shape
            loss, total, g, h = np.zeros(m), np.zeros(m), np.zeros((m, d)), np.zeros((m, d, d))
            for x, y, folds in _blocks(batches):
                x1 = np.hstack([x, np.ones((len(x), 1))])
                c = _trained(folds, masks)[:, of] * weight[of][:, y].T
                z = x1 @ w.T
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss += (c * (np.logaddexp(0, z) - y[:, None] * z)).sum(0)
                total += c.sum(0)
                g += (c * (p - y[:, None])).T @ x1
                curve = c * p * (1 - p)
                for k in range(m):
                    h[k] += (x1 * curve[:, k : k + 1]).T @ x1
            yield _row([loss, total, g, h])

        found = _added(rows.mapInArrow(work, "what int, value binary"))
        held.destroy()
        d = width + 1
        loss, total, g, h = found[0], np.maximum(found[1], 1e-300), found[2].reshape(-1, d), found[3].reshape(-1, d, d)
        going = []
        for k, i in enumerate(open_):
            now = loss[k] / total[k] + penalty(trial[k], i)
            if now > value[i] + 1e-4 * share[i] * promise[i] + 1e-15 * abs(value[i]) and share[i] > 1e-6:
                share[i] /= 2
                going.append(i)
                continue
            at[i], value[i], share[i] = trial[k], now, 1.0
            s = scale[i]
            gk, hk = g[k] * s / total[k], h[k] * np.outer(s, s) / total[k]
            step[i] = _descend(gk, hk, at[i], l1[i], l2[i])
            step[i][s == 0] = 0
            promise[i] = gk @ step[i] + penalty(at[i] + step[i], i) - penalty(at[i], i)
            if np.abs(step[i]).max() > tolerance:
                going.append(i)
        open_ = np.array(going, int)
        if not len(open_):
            break
    return at * scale


def scores(df: DataFrame, x: str, coefficients: np.ndarray) -> DataFrame:
    """df with scores: the chance of class 1 by every fit, as an array."""
    held = df.sparkSession.sparkContext.broadcast(coefficients)

    @F.pandas_udf("array<double>")
    def chances(rows):
        import pandas as pd

        w = held.value
        return pd.Series(list(1 / (1 + np.exp(-np.clip(np.stack(rows.to_numpy()) @ w[:, :-1].T + w[:, -1], -700, 700)))) if len(rows) else [])

    return df.withColumn("scores", chances(F.col(x).cast("array<double>")))
