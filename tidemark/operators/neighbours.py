"""Exact nearest neighbours: cells around pivots, visited only where the triangle inequality leaves a chance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import folder

#: Pivots, at most, and training rows among which they are looked for.
PIVOTS, SAMPLE = 512, 4096
#: Training rows of a cell, about, and cells at most (larger tables get larger cells).
CELL, CELLS = 2048, 16_384
#: Queries that meet one cell in one task, and that are compared together there.
MEET, TOGETHER = 8192, 4
#: Queries that look for their cells at once, and visits that leave a task as one Arrow batch (each carries its query's vector).
ROUTED, VISITS = 256, 4096
#: Room for rounding where bounds of distances are compared.
SLACK = 1e-9


def _far_apart(sample: np.ndarray, many: int) -> np.ndarray:
    """Rows of a sample, each one the farthest from those before it."""
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(many, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.stack([((b - row) ** 2).sum(1) for row in a])) if len(a) else np.zeros((0, len(b)))


def _nearest(pivots) -> Column:
    """The nearest pivot's number and its distance."""

    @F.pandas_udf("cell int, r double")
    def place(x: pd.Series) -> pd.DataFrame:
        d = _apart(np.stack(x.to_numpy()), pivots.value) if len(x) else np.zeros((0, 1))
        at = d.argmin(1)
        return pd.DataFrame({"cell": at.astype(np.int32), "r": d[np.arange(len(d)), at]})

    return place(F.col("_v"))


def _matrix(table: pa.Table, name: str) -> np.ndarray:
    column = table.column(name).combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _compare(k: int):
    """Queries and rows of one cell: each query's k nearest rows among those whose distance from the pivot fits."""

    def work(rows: pa.Table, queries: pa.Table) -> pa.Table:
        names = ["q", "t", "distance", "label", "compared"]
        found: list[tuple] = []
        compared = 0
        if len(rows) and len(queries):
            rows, queries = rows.sort_by([("r", "ascending"), ("_t", "ascending")]), queries.sort_by("d")
            r, t, label, v = rows.column("r").to_numpy(), rows.column("_t").to_numpy(), rows.column("_y").to_numpy(zero_copy_only=False), _matrix(rows, "_v")
            q, d, reach, w = queries.column("_q").to_numpy(), queries.column("d").to_numpy(), queries.column("reach").to_numpy(), _matrix(queries, "_v")
            for i in range(0, len(q), TOGETHER):
                some = slice(i, i + TOGETHER)
                a, b = int(np.searchsorted(r, (d[some] - reach[some]).min())), int(np.searchsorted(r, (d[some] + reach[some]).max(), "right"))
                compared += (b - a) * len(q[some])
                far = np.sqrt(((v[None, a:b] - w[some, None]) ** 2).sum(2))
                far[t[None, a:b] == q[some, None]] = np.inf
                far[far > reach[some, None]] = np.inf
                for name, row in zip(q[some], far):
                    near = np.flatnonzero(row <= (np.partition(row, k - 1)[k - 1] if len(row) > k else np.inf))
                    near = near[np.lexsort((t[a:b][near], row[near]))][:k]
                    near = near[np.isfinite(row[near])]
                    found.append((np.full(len(near), name), t[a:b][near], row[near], label[a:b][near]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64)] * 2 + [np.zeros(0)] + [np.zeros(0, np.int64)]
        out = [pa.array(c.astype(kind)) for c, kind in zip(columns, (np.int64, np.int64, np.float64, np.int64))]
        out = [pa.concat_arrays([c, pa.nulls(1, c.type)]) for c in out]  # the last row tells how many pairs were compared
        return pa.Table.from_arrays([*out, pa.array([0] * (len(out[0]) - 1) + [compared], pa.int64())], names)

    return work


def _route(pivots, bounds, k: int):
    """Queries to the cells whose rings can hold a row within their bound, a batch of at most VISITS at a time."""

    def route(batches):
        (near, cell) = bounds.value
        near_cell, near_r, home = near[:, 0].astype(int), near[:, 1], cell[:, 0].astype(int)
        for batch in batches:
            for at in range(0, batch.num_rows, ROUTED):
                part = pa.Table.from_batches([batch.slice(at, ROUTED)])
                d = _apart(_matrix(part, "_v"), pivots.value)
                sums = d[:, near_cell] + near_r
                reach = (np.partition(sums, k, axis=1)[:, k] if sums.shape[1] > k else np.full(len(d), np.inf)) * (1 + SLACK) + SLACK
                mine = d[:, home]
                every = np.nonzero((cell[:, 2] <= mine + reach[:, None]) & (cell[:, 3] >= mine - reach[:, None]))
                for i in range(0, len(every[0]), VISITS):
                    q, c = (e[i : i + VISITS] for e in every)
                    yield pa.RecordBatch.from_arrays([part.column("_q").take(pa.array(q)).combine_chunks(), part.column("_v").take(pa.array(q)).combine_chunks(), pa.array(home[c], pa.int32()), pa.array(cell[c, 1].astype(np.int32)), pa.array(mine[q, c]), pa.array(reach[q])], ["_q", "_v", "cell", "ring", "d", "reach"])

    return route


def visits(queries: DataFrame, train: DataFrame, qid: str, tcol: str, x: str, y: str, k: int, cell_rows: int | None = None, seed: int = 0) -> DataFrame:
    """q, t, distance, label: each query's k nearest rows of every cell that it visits; rows with t null count the compared pairs.

    1. Training rows far apart in a bounded sample are the pivots; every row goes to its nearest one, and a
       pivot's rows into rings by their distance from it, until cells hold about cell_rows rows (rings
       that still hold more are dealt further by hash). 2. The k + 1 rows nearest to each pivot bound
       a query's k-th distance: no more than its distance to the pivot and theirs together. 3. A query visits
       the cells whose rings can hold a row within that bound, and there meets only rows whose distance
       from the pivot differs by no more from its own.

    Of equal rows only the k + 1 of smallest id can be among anyone's k nearest; others are left out.
    Pivots and bounds of cells (PIVOTS x (k + 1) and CELLS at most, however many rows) are held by the driver and all tasks.
    """
    spark = train.sparkSession
    rows = train.select(F.col(tcol).cast("long").alias("_t"), F.col(x).cast("array<double>").alias("_v"), F.col(y).cast("long").alias("_y")).where("_v is not null and _t is not null")
    equal = Window.partitionBy("_v").orderBy("_t", "_y")
    rows = rows.withColumn("_k", F.row_number().over(equal)).where(F.col("_k") <= k + 1).drop("_k")
    asked = queries.select(F.col(qid).cast("long").alias("_q"), F.col(x).cast("array<double>").alias("_v")).where("_v is not null and _q is not null")
    sample = rows.select("_v", F.xxhash64("_t", F.lit(seed)).alias("_h")).orderBy("_h", "_v").limit(SAMPLE).collect()
    empty = spark.createDataFrame([], "q long, t long, distance double, label long, compared long")
    if not sample:
        return empty
    n = rows.count()
    pivots = spark.sparkContext.broadcast(_far_apart(np.array([r["_v"] for r in sample]), min(PIVOTS, max(1, round(n**0.5)))))
    path = folder(spark, "placed")
    rows.withColumn("_p", _nearest(pivots)).select("_t", "_v", "_y", "_p.cell", "_p.r").write.parquet(path)
    placed = spark.read.parquet(path)
    size = cell_rows or max(CELL, -(-n // CELLS))
    close = Window.partitionBy("cell").orderBy("r", "_t")
    best = [(r["cell"], r["r"]) for r in placed.withColumn("_k", F.row_number().over(close)).where(F.col("_k") <= k + 1).select("cell", "r").collect()]
    spans = placed.groupBy("cell").agg(F.max("r").alias("_far"), F.ceil(F.count("*") / size).alias("_rings"))
    ringed = placed.join(F.broadcast(spans), "cell").withColumn("ring", F.least(F.col("_rings") - 1, F.floor(F.coalesce(F.try_divide(F.col("r") * F.col("_rings"), F.col("_far")), F.lit(0)))).cast("int"))
    cells = ringed.groupBy("cell", "ring").agg(F.min("r").alias("low"), F.max("r").alias("high"), F.count("*").alias("n"))
    known = cells.orderBy("cell", "ring").collect()
    bounds = spark.sparkContext.broadcast((np.array(best), np.array([(c["cell"], c["ring"], c["low"], c["high"]) for c in known])))

    routed = asked.mapInArrow(_route(pivots, bounds, k), "_q long, _v array<double>, cell int, ring int, d double, reach double")
    met = routed.groupBy("cell", "ring").agg(F.ceil(F.count("*") / MEET).alias("_sets"))
    plan = cells.join(met, ["cell", "ring"]).select("cell", "ring", F.ceil(F.col("n") / (2 * size)).alias("_parts"), "_sets")
    each = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    deal = lambda c, many: F.pmod(F.xxhash64(c), F.col(many))
    left = ringed.join(F.broadcast(plan), ["cell", "ring"]).select("cell", "ring", deal("_t", "_parts").alias("part"), each("_sets").alias("set"), "_t", "_v", "_y", "r")
    right = routed.join(F.broadcast(plan), ["cell", "ring"]).select("cell", "ring", each("_parts").alias("part"), deal("_q", "_sets").alias("set"), "_q", "_v", "d", "reach")
    key = ["cell", "ring", "part", "set"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_compare(k), "q long, t long, distance double, label long, compared long")


def knn_join(queries: DataFrame, train: DataFrame, qid: str, tid: str, x: str, y: str, k: int, cell_rows: int | None = None, tcol: str | None = None) -> DataFrame:
    """qid, tid, distance, label, rank: each query's k nearest training vectors, exactly; ties go to the smaller id.

    tcol: the training rows' id column, if not named like qid; a row is no neighbour of its own id. Rows
    whose vector is null take no part. See visits() for the way.
    """
    near = visits(queries, train, qid, tcol or qid, x, y, k, cell_rows).where("t is not null").drop("compared")
    w = Window.partitionBy("q").orderBy("distance", "t")
    return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).withColumnsRenamed({"q": qid, "t": tid})
