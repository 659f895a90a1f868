"""Trial results: summaries of folds, fronts and rankings."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import split_last
from tidemark.sources.scratch import folder


def fold_summary(df: DataFrame, by: list[str], train: str, val: str) -> DataFrame:
    """Mean and population deviation of train and validation metrics over folds, and their gap."""
    return df.groupBy(*by).agg(F.avg(train).alias("mean_train"), F.stddev_pop(train).alias("std_train"), F.avg(val).alias("mean_val"), F.stddev_pop(val).alias("std_val")).withColumn("gap", F.col("mean_train") - F.col("mean_val"))


#: Cells of the grid by which dominance is decided, about.
CELLS = 4096


def _front(points: np.ndarray, others: np.ndarray | None = None) -> np.ndarray:
    """Which points no other point (of `others`, or of their own where that is not given) dominates."""
    keep = np.ones(len(points), bool)
    if others is not None:
        for i in range(0, len(points), 64):
            mine = points[i : i + 64, None]
            for j in range(0, len(others), 4096):
                some = others[None, j : j + 4096]
                keep[i : i + 64] &= ~((some >= mine).all(2) & (some > mine).any(2)).any(1)
        return keep
    order = np.argsort(-points.sum(1), kind="stable")  # who dominates has the larger sum
    front = np.zeros((0, points.shape[1]))
    for i in range(0, len(order), 256):
        mine = order[i : i + 256]
        keep[mine] = _front(points[mine], front)
        mine = mine[keep[mine]]
        keep[mine] = _front(points[mine], points[mine])
        front = np.vstack([front, points[mine[keep[mine]]]])
    return keep


def pareto_front(df: DataFrame, *columns: str, cells: int = CELLS) -> DataFrame:
    """Rows that no other row dominates (at least as good in all columns, better in one), for any number of columns.

    Columns are cut at approximate quantiles into a grid of about `cells` cells, whatever the values' skew. A
    cell with another above it in every column holds no row of the front and goes. Tasks first thin out what
    they read, then each cell keeps its own front, and what is left of a cell meets the fronts of those cells
    that aren't below it in any column. Rows with a null or NaN in a column take no part; repeated rows
    stay together. The occupied cells, no more than the grid has, are all that reaches the driver.
    """
    names, width = list(columns), len(columns)
    sound = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) for c in names])
    points = df.where(sound).select(F.array(*[F.col(c).cast("double") for c in names]).alias("p"))
    parts = max(2, round(cells ** (1 / width)))
    cuts = df.where(sound).agg(*[F.percentile_approx(F.col(c).cast("double"), F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(10_000)).alias(c) for c in names]).first()
    if cuts[0] is None:
        return df.where(F.lit(False))
    edges = [np.unique(np.array(c)) for c in cuts]

    def place(points: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, points[:, k]) for k, e in enumerate(edges)], 1)

    def thinned(batches):
        for batch in batches:
            p = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, width)
            p = np.unique(p[_front(p)], axis=0)
            c = place(p).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(list(p), pa.list_(pa.float64())), pa.array(list(c), pa.list_(pa.int32()))], ["p", "cell"])

    path = folder(df.sparkSession, "front")
    points.mapInArrow(thinned, "p array<double>, cell array<int>").write.parquet(path)
    left = df.sparkSession.read.parquet(path)
    every = np.array([r["cell"] for r in left.select("cell").distinct().collect()])
    alive = np.array([not (every > c).all(1).any() for c in every])
    few = every[alive]
    below = {tuple(c): few[(few <= c).all(1)].tolist() for c in few}

    def own(table: pa.Table) -> pa.Table:
        p = np.unique(np.array(table.column("p").to_pylist()), axis=0)
        p = p[_front(p)]
        return pa.table({"cell": pa.array([table.column("cell")[0].as_py()] * len(p), pa.list_(pa.int32())), "p": pa.array(list(p), pa.list_(pa.float64()))})

    def spread(batches):
        for batch in batches:
            cell, p = batch.column(0).to_pylist(), batch.column(1)
            to = [below[tuple(c)] for c in cell]
            at = np.repeat(np.arange(len(to)), [len(t) for t in to])
            yield pa.RecordBatch.from_arrays([pa.array([c for t in to for c in t], pa.list_(pa.int32())), p.take(pa.array(at)), pa.array([c == cell[i] for i, t in enumerate(to) for c in t])], ["cell", "p", "own"])

    def merged(table: pa.Table) -> pa.Table:
        p, mine = np.array(table.column("p").to_pylist()), table.column("own").to_numpy()
        p, others = p[mine], p[~mine]
        p = p[_front(p, others)] if len(others) else p
        return pa.table({f"_{k}": p[:, k] for k in range(width)})

    chosen = df.sparkSession.createDataFrame([(c,) for c in few.tolist()], "cell array<int>")
    fronts = left.join(F.broadcast(chosen), "cell").groupBy("cell").applyInArrow(own, "cell array<int>, p array<double>")
    met = fronts.mapInArrow(spread, "cell array<int>, p array<double>, own boolean")
    front = met.groupBy("cell").applyInArrow(merged, ", ".join(f"_{k} double" for k in range(width)))
    same = reduce(lambda a, b: a & b, [F.col(c).cast("double") == F.col(f"_{k}") for k, c in enumerate(names)])
    return df.join(front, same, "left_semi")


def top_k(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group, with their rank."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def leaderboard(train: DataFrame, val: DataFrame, test: DataFrame, on: list[str], sort: str) -> DataFrame:
    """Metrics of the three sets side by side, ranked by one of them."""
    joined = train.join(val, on).join(test, on)
    return joined.withColumn("rank", F.rank().over(Window.orderBy(F.col(sort).desc())))  # a row a trial


def melt(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    return df.unpivot(ids, values, "metric", "value")


def split_name(df: DataFrame, name: str) -> DataFrame:
    model, mode = split_last(name)
    return df.withColumns({"model": model, "datamode": mode})


def param_grid(spark, grid: dict[str, list], seed: int = 42) -> DataFrame:
    """All combinations of settings, in a seeded order, with their text."""
    rows = [(n, str(v)) for n, values in grid.items() for v in values]
    return grid_of(spark.createDataFrame(rows, "name string, value string"), list(grid), seed)


def grid_of(values: DataFrame, names: list[str], seed: int = 42) -> DataFrame:
    """The same from (name, value) rows: each name's few values as one array, unfolded one after the other."""
    out = values.agg(*[F.array_sort(F.collect_set(F.when(F.col("name") == n, F.col("value")))).alias(n) for n in names])
    for n in names:
        out = out.withColumn(n, F.explode(n))
    text = F.concat_ws(" ", *[F.concat(F.lit(f"--{n}="), F.col(n)) for n in names])
    return out.withColumns({"setting": text, "shuffle": F.xxhash64(text, F.lit(seed))}).orderBy("shuffle", "setting").drop("shuffle")
