"""Principal components of wide arrays: randomized range finding with power steps, nothing larger than width x components."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.tree import added

#: Arrays of up to this width take all their directions in one block, which needs no power steps.
NARROW = 1024
#: Directions of one block for wider arrays.
BLOCK = 256
#: Rows of a slab of the width x block product that travel as one value.
SLAB = 1024


@dataclass
class Components:
    """mean, vectors (a component a row), values (variances, falling) and the total variance of all directions."""

    mean: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    total: float

    def shares(self) -> list[float]:
        return [float(v / self.total) if self.total > 0 else 0.0 for v in self.values]

    def project(self, df: DataFrame, x: str = "x") -> DataFrame:
        """x as coordinates along the components."""
        held = df.sparkSession.sparkContext.broadcast((self.mean, self.vectors.T.copy()))

        @F.pandas_udf("array<double>")
        def along(rows: pd.Series) -> pd.Series:
            mean, vectors = held.value
            return pd.Series(list((np.stack(rows.to_numpy()) - mean) @ vectors) if len(rows) else [])

        return df.withColumn(x, along(F.col(x).cast("array<double>")))


def _rows(batch: pa.RecordBatch, at: int, rows: int) -> np.ndarray:
    part = batch.column(0).slice(at, rows)
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def _sums(df: DataFrame) -> tuple[int, np.ndarray]:
    """Number of rows and their mean."""

    def work(batches):
        n, total = 0, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                a = _rows(batch, at, 256)
                n, total = n + len(a), a.sum(0) if total is None else total + a.sum(0)
        if n:
            yield pa.RecordBatch.from_pydict({"what": pa.array([0], pa.int32()), "value": pa.array([np.append(total, n).tobytes()], pa.binary())})

    row = added(df.mapInArrow(work, "what int, value binary").withColumn("part", F.monotonically_increasing_id()), "sum").first()
    if row is None:
        return 0, np.zeros(0)
    both = np.frombuffer(row["value"], np.float64)
    return int(both[-1]), both[:-1] / both[-1]


def _pass(df: DataFrame, mean: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """R of the centred rows' coordinates along q (each task reduces its own by QR), scatter times q, and the total scatter."""
    held = df.sparkSession.sparkContext.broadcast((mean, q))

    def work(batches):
        mean, q = held.value
        r, z, total = np.zeros((0, q.shape[1])), np.zeros(q.shape), 0.0
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                a = _rows(batch, at, 256) - mean
                y = a @ q
                r = np.linalg.qr(np.vstack([r, y]), mode="r")
                z += a.T @ y
                total += float((a * a).sum())
        if len(r):
            square = np.zeros((q.shape[1],) * 2)
            square[: len(r)] = r
            slabs = [z[k : k + SLAB] for k in range(0, len(z), SLAB)]
            values = [square.tobytes(), np.array([total]).tobytes(), *(s.tobytes() for s in slabs)]
            yield pa.RecordBatch.from_pydict({"what": pa.array(range(-2, len(slabs)), pa.int32()), "value": pa.array(values, pa.binary()), "task": pa.array([0] * len(values), pa.int64())})

    parts = df.mapInArrow(work, "what int, value binary, task long").withColumn("part", F.shiftright(F.monotonically_increasing_id(), 33)).drop("task")
    found = {r["what"]: np.frombuffer(r["value"], np.float64) for r in added(parts.where("what != -2"), "sum").unionByName(added(parts.where("what = -2"), "qr")).collect()}
    held.destroy()
    z = np.vstack([found[k].reshape(-1, q.shape[1]) for k in range(len(found) - 2)])
    return found[-2].reshape(-1, q.shape[1]), z, float(found[-1][0])


def _orthonormal(a: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Columns that span a, without the directions of `against` (rows); twice, since once leaves rounding behind."""
    for _ in range(2):
        a = np.linalg.qr(a - against.T @ (against @ a))[0]
    return a


def fit(train: DataFrame, x: str = "x", variance: float = 0.95, most: int = 5000, block: int | None = None, tolerance: float = 1e-10, steps: int = 40, seed: int = 0) -> Components:
    """The fewest leading components that explain more than `variance` of train's arrays, `most` of them at most.

    A block of directions, random at first, goes through the data: each pass multiplies it with the scatter
    (a power step) and gives its Rayleigh-Ritz values from the tasks' R factors. Leading directions whose
    residual is below tolerance x the largest value are kept, and the block goes on without them and with new
    random ones, until enough variance is explained; directions that don't converge within `steps` passes are
    kept as they are. Arrays up to NARROW wide are one block and take one pass. Tasks and driver hold width x
    (components + block) numbers. Rows whose array is null are left out; without rows there are no components.
    """
    rows = train.select(F.col(x).cast("array<double>").alias("x")).where("x is not null")
    n, mean = _sums(rows)
    d = len(mean)
    most = min(n, d, most)
    if not most:
        return Components(mean, np.zeros((0, d)), np.zeros(0), 0.0)
    size = min(d, block or (d if d <= NARROW else BLOCK))
    rng = np.random.default_rng(seed)
    kept, values = np.zeros((0, d)), np.zeros(0)
    q, age = _orthonormal(rng.normal(size=(d, size)), kept), 0
    while True:
        r, z, total = _pass(rows, mean, q)
        _, s, w = np.linalg.svd(r, full_matrices=False)
        v, image, age = q @ w.T, z @ w.T, age + 1
        left = np.linalg.norm(image - v * s**2, axis=0)
        top = max(float(values.max(initial=0)), float((s**2).max(initial=0)))
        whole = size + len(kept) >= d
        fine = len(s) if whole or age >= steps or top == 0 else int(np.argmin(np.append(left <= tolerance * top, False)))
        kept, values = np.vstack([kept, v[:, :fine].T]), np.append(values, s[:fine] ** 2)
        enough = np.flatnonzero(np.cumsum(values) > variance * total)
        if len(enough) or len(values) >= most or whole:
            k = min(most, enough[0] + 1 if len(enough) else len(values))
            return Components(mean, kept[:k], values[:k] / max(1, n - 1), total / max(1, n - 1))
        age = 0 if fine else age
        q = _orthonormal(np.hstack([image[:, fine:], rng.normal(size=(d, fine))])[:, : min(size, d - len(kept))], kept)


def by_variance(train: DataFrame, test: DataFrame, x: str = "x", variance: float = 0.95, most: int = 5000) -> tuple[DataFrame, DataFrame, list[float]]:
    """Both frames along the fewest components of the training rows that explain more than `variance`, and the components' shares."""
    found = fit(train, x, variance, most)
    return found.project(train, x), found.project(test, x), found.shares()
