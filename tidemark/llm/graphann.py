"""Approximate nearest neighbours by robust-pruned directed graphs, one for each shard of vectors."""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read_table

#: Rows of a shard: a sixteenth of all, within these bounds. Every query visits every shard, so large tables get large shards.
SHARD_LEAST, SHARD_MOST = 1 << 12, 1 << 16
#: Queries of one block.
QUERY_BLOCK = 512
#: Most edges of a node, relaxation of the pruning rule, beam width when building and when searching.
DEGREE, ALPHA, BUILD_BEAM, BEAM = 24, 1.2, 48, 128
#: Entries of a shard's graph: one for so many nodes, and at most; a search starts at the START nearest of them.
ENTRY_NODES, ENTRIES, START = 32, 512, 12
#: Further edges of a node, for nodes that no entry leads to otherwise.
SPARE = 4
K = 10


def _distances(x: np.ndarray, q: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Squared distances of each query to the vectors named in its row of ids."""
    d = x[ids] - q[:, None, :]
    return np.einsum("qcd,qcd->qc", d, d)


def beam_search(x: np.ndarray, edges: np.ndarray, entries: np.ndarray | int, q: np.ndarray, beam: int, keep_visited: bool = False):
    """Greedy search of all queries in step, from the entries nearest to each: it expands its nearest unexpanded candidate.

    edges: (n, degree) neighbour numbers, -1 for none. Returns the beam's ids and squared distances,
    nearest first (-1 and inf for none), and the expanded nodes of each query if asked.
    """
    n_q = len(q)
    ids = np.full((n_q, beam), -1, np.int64)
    dist = np.full((n_q, beam), np.inf)
    done = np.zeros((n_q, beam), bool)
    entries = np.atleast_1d(entries)
    many = min(beam, START, len(entries))
    rough = (x[entries] ** 2).sum(1) - 2 * (q @ x[entries].T)
    ids[:, :many] = entries[np.argpartition(rough, many - 1, axis=1)[:, :many]]
    dist[:, :many] = _distances(x, q, ids[:, :many])
    visited: list[np.ndarray] = []
    seen = np.zeros((n_q, len(x)), bool)
    seen[np.arange(n_q)[:, None], ids[:, :many]] = True
    while True:
        open_ = np.where(done | (ids < 0), np.inf, dist)
        pick = open_.argmin(1)
        rows = np.flatnonzero(np.isfinite(open_[np.arange(n_q), pick]))
        if not len(rows):
            break
        at = pick[rows]
        done[rows, at] = True
        node = ids[rows, at]
        if keep_visited:
            step = np.full(n_q, -1, np.int64)
            step[rows] = node
            visited.append(step)
        near = edges[node]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        r, c = np.nonzero(fresh)
        seen[rows[r], near[r, c]] = True
        d = np.full(near.shape, np.inf)
        diff = x[near[r, c]] - q[rows[r]]
        d[r, c] = np.einsum("cd,cd->c", diff, diff)
        all_ids = np.concatenate((ids[rows], np.where(fresh, near, -1)), 1)
        all_dist = np.concatenate((dist[rows], d), 1)
        all_done = np.concatenate((done[rows], np.zeros(near.shape, bool)), 1)
        order = np.argsort(all_dist, 1, kind="stable")[:, :beam]
        ids[rows] = np.take_along_axis(all_ids, order, 1)
        dist[rows] = np.take_along_axis(all_dist, order, 1)
        done[rows] = np.take_along_axis(all_done, order, 1)
        ids[rows] = np.where(np.isfinite(dist[rows]), ids[rows], -1)
    return ids, dist, (np.stack(visited, 1) if visited else np.zeros((n_q, 0), np.int64))


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray, alpha: float, degree: int) -> np.ndarray:
    """Edges of each point from its candidates (-1 for none): the nearest stays, and drops every candidate
    that it is nearer to than the point by a factor of alpha; and so on, up to degree edges."""
    b, c = candidates.shape
    candidates = np.sort(candidates, 1)
    alive = candidates >= 0
    alive[:, 1:] &= candidates[:, 1:] != candidates[:, :-1]
    alive &= candidates != points[:, None]
    vectors = x[np.maximum(candidates, 0)]
    d = np.where(alive, _distances(x, x[points], np.maximum(candidates, 0)), np.inf)
    norms = np.einsum("bcd,bcd->bc", vectors, vectors)
    apart = norms[:, :, None] + norms[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))  # between candidates, squared
    edges = np.full((b, degree), -1, np.int64)
    rows = np.arange(b)
    for k in range(degree):
        pick = d.argmin(1)
        ok = np.isfinite(d[rows, pick])
        if not ok.any():
            break
        edges[ok, k] = candidates[rows, pick][ok]
        d[(alpha * alpha * apart[rows, pick] <= d) | (np.arange(c) == pick[:, None])] = np.inf
    return edges


def entries_of(x: np.ndarray) -> np.ndarray:
    """The node nearest to the middle, then nodes each of which is the farthest from those before it: one in every tight
    cluster, as long as there are no more of them than entries."""
    chosen = [int(((x - x.mean(0)) ** 2).sum(1).argmin())]
    far = ((x - x[chosen[0]]) ** 2).sum(1)
    for _ in range(min(ENTRIES, len(x) // ENTRY_NODES)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return np.unique(chosen)


def reached(edges: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Which nodes some entry leads to."""
    seen = np.zeros(len(edges), bool)
    front = np.unique(entries)
    seen[front] = True
    while len(front):
        near = np.unique(edges[front])
        front = near[(near >= 0) & ~seen[np.maximum(near, 0)]]
        seen[front] = True
    return seen


def reconnect(x: np.ndarray, edges: np.ndarray, entries: np.ndarray, beam: int, batch: int) -> np.ndarray:
    """edges with SPARE more columns: a node that no entry leads to gets an edge from the nearest node found that has one to
    spare, batch after batch, until there is none left."""
    edges = np.hstack([edges, np.full((len(edges), SPARE), -1, edges.dtype)])
    used = np.zeros(len(edges), np.int64)
    while len(lost := np.flatnonzero(~reached(edges, entries))):
        some = lost[:: max(1, len(lost) // batch)][:batch]
        ids, _, _ = beam_search(x, edges, entries, x[some], beam)
        free = np.flatnonzero(reached(edges, entries) & (used < SPARE))
        for point, near in zip(some, ids):
            near = near[near >= 0]
            near = near[used[near] < SPARE]
            if not len(near) and not len(free):
                break  # those just linked have edges to spare in the next round
            at = near[0] if len(near) else free[((x[free] - x[point]) ** 2).sum(1).argmin()]
            edges[at, edges.shape[1] - SPARE + used[at]] = point
            used[at] += 1
            free = free[used[free] < SPARE]
    return edges


def build_graph(x: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA, beam: int = BUILD_BEAM, batch: int = 128, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Edges and entries of a shard's graph: two passes over all points in batches, first without relaxation; then every
    node that can't be reached from an entry is linked."""
    n = len(x)
    entry = entries_of(x)
    if n <= degree + 1:  # everyone's neighbour
        full = np.tile(np.arange(n), (n, 1))
        edges = np.full((n, degree), -1, np.int64)
        edges[:, : n - 1] = full[~np.eye(n, dtype=bool)].reshape(n, n - 1)
        return edges, entry
    rng = np.random.default_rng(seed)
    edges = rng.integers(0, n, (n, degree))
    edges[edges == np.arange(n)[:, None]] = -1
    for a in (1.0, alpha):
        order = rng.permutation(n)
        for start in range(0, n, batch):
            points = order[start : start + batch]
            ids, _, visited = beam_search(x, edges, entry, x[points], beam, keep_visited=True)
            edges[points] = robust_prune(x, points, np.concatenate((visited, ids, edges[points]), 1), a, degree)
            # edges back; nodes with too many are pruned again
            to, back = edges[points].ravel(), np.repeat(points, degree)
            to, back = to[to >= 0], back[to >= 0]
            sort = np.argsort(to, kind="stable")
            to, back = to[sort], back[sort]
            targets, first, count = np.unique(to, return_index=True, return_counts=True)
            if not len(targets):
                continue
            wide = np.full((len(targets), int(count.max())), -1, np.int64)
            wide[np.repeat(np.arange(len(targets)), count), np.arange(len(to)) - np.repeat(first, count)] = back
            for k in range(0, len(targets), 8 * batch):
                t, more = targets[k : k + 8 * batch], wide[k : k + 8 * batch]
                edges[t] = robust_prune(x, t, np.concatenate((edges[t], more), 1), a, degree)
    return reconnect(x, edges, entry, beam, batch), entry


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and x (doubles) of rows that take part: not null, not zero, all components finite."""
    x = F.col("embedding").cast("array<double>")
    bad = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vectors.select("vec_id", x.alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("x", lambda v: v != 0))


def _distances_exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = x - q
    return np.sqrt((d * d).sum(-1))


def build_index(vectors: DataFrame, shard_rows: int | None = None) -> DataFrame:
    """shard, n_shards, width, and the shard's graph with its vectors: one row for each shard of about shard_rows rows.

    Vectors of different lengths go to different shards. Every usable row is indexed; nothing is sampled.
    A node is a distinct vector with all rows that hold it, so copies can't crowd a node's edges. Rows that
    repeat a vec_id with its vector are counted before they are dealt, so a hot vec_id is one row with its
    number. Rows that can't take part (see usable) are left out; an empty table gives an empty index; other columns are not read.
    """
    rows = usable(vectors).groupBy("vec_id", "x").agg(F.count("*").alias("times")).withColumn("width", F.size("x"))
    rows = materialize(rows, "vectors")
    n = rows.count()
    shards = max(1, -(-n // (shard_rows or min(max(SHARD_LEAST, n // 16), SHARD_MOST))))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        every = np.stack(pdf["x"].to_numpy()).astype(np.float64) + 0.0
        x, place = np.unique(every, axis=0, return_inverse=True)
        edges, entry = build_graph(x)
        order = np.argsort(place.ravel(), kind="stable")  # rows of one vector together, by vec_id
        starts = np.searchsorted(place.ravel()[order], np.arange(len(x) + 1))
        graph = (pdf["vec_id"].to_numpy(np.int64)[order], pdf["times"].to_numpy(np.int64)[order], starts, x, edges.astype(np.int32), entry)
        return pd.DataFrame({"shard": [key[0]], "n_shards": [shards], "width": [key[1]], "graph": [pickle.dumps(graph, 5)]})

    dealt = rows.repartition(8 * shards, "shard", "width")  # few shards share a task
    return materialize(dealt.groupBy("shard", "width").applyInPandas(build, "shard int, n_shards int, width int, graph binary"), "graphs")


def search(index: DataFrame, queries: DataFrame, k: int = K, beam: int = BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """Each query's k nearest found over all shards: query_id, rank, vec_id, score (Euclidean distance).

    Every query visits every shard's graph of its width. Queries are dealt into sets of 64 blocks; a task has
    one shard's graph, loaded once, and one set, searched block by block, and gives k rows a query. queries:
    usable rows (vec_id, x). A query is a distinct (vec_id, x): rows that repeat
    it are answered once, a vec_id with two vectors has two answers. A row is no neighbour of its own
    vec_id; repeated rows of another are each a neighbour. Ties go to the smaller vec_id. No queries or an
    empty index give an empty result.
    """
    shards = (index.select("n_shards").first() or [1])[0]
    asked = queries.select("vec_id", "x").dropDuplicates().withColumns({"width": F.size("x"), "vector": F.xxhash64("x")})
    sets = max(1, -(-queries.count() // (64 * block)))
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    put = asked.withColumns({"set": F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(sets)).cast("int"), "shard": each(shards)})
    graphs = index.select("shard", "width", "graph", each(sets).alias("set"))
    types = pa.schema([("query_id", pa.int64()), ("vector", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def work(queries: pa.Table, graphs: pa.Table) -> pa.Table:
        if not len(queries) or not len(graphs):
            return types.empty_table()
        ids, times, starts, x, edges, entries = pickle.loads(graphs.column("graph")[0].as_py())
        queries, out = queries.sort_by([("vec_id", "ascending"), ("vector", "ascending")]), []
        for at in range(0, len(queries), block):
            asked = queries.slice(at, block)
            names, vectors = asked.column("vec_id").to_numpy(), asked.column("vector").to_numpy()
            column = asked.column("x").combine_chunks()
            q = column.flatten().to_numpy().reshape(len(column), -1)
            found, _, _ = beam_search(x, edges, entries, q, min(beam, len(x)))
            r, c = np.nonzero(found >= 0)
            hit = found[r, c]
            many = np.minimum(starts[hit + 1] - starts[hit], k + 1)  # a vector's first k rows besides the query's own
            place = np.repeat(starts[hit], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
            r, hit = np.repeat(r, many), np.repeat(hit, many)
            other = ids[place] != names[r]
            again = np.minimum(times[place[other]], k)
            r, hit, vec = np.repeat(r[other], again), np.repeat(hit[other], again), np.repeat(ids[place[other]], again)
            score = _distances_exact(x[hit], q[r])
            order = np.lexsort((vec, score, r))
            r, vec, score = r[order], vec[order], score[order]
            top = np.arange(len(r)) - np.searchsorted(r, r) < k
            out.append(pa.Table.from_arrays([pa.array(names[r[top]]), pa.array(vectors[r[top]]), pa.array(vec[top]), pa.array(score[top])], schema=types))
        return pa.concat_tables(out)

    key = ["shard", "width", "set"]
    near = put.groupBy(*key).cogroup(graphs.groupBy(*key)).applyInArrow(work, "query_id long, vector long, vec_id long, score double")
    order = Window.partitionBy("query_id", "vector").orderBy("score", "vec_id")  # each task keeps k rows a query before the shuffle
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings")
    return search(build_index(vectors), usable(vectors).where("vec_id % 100 = 0"))
