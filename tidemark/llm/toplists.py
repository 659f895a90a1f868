"""Exact top-k by integer inner product: sorted lists read in step, without random access (NRA)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, power_of_two, read_table

#: Each component x becomes floor(SCALE * x).
SCALE = 256
#: Rows that share one set of sorted lists; the first sets are smaller, so that a first k-th score is known early.
LEAF = 4096
FIRST_LEAF = 256
#: Queries that read a set of lists together.
TOGETHER = 512
#: Shares of every list that have been read when bounds are drawn up.
DEPTHS = (0.25, 0.5, 0.75)
#: Reading stops and what is left is resolved when so small a share of (query, row) is still open.
FEW = 1 / 8
#: Rows of a shard and queries of a block, at most.
SHARD = BLOCK = 65_536
_PAIRS = 1 << 15
_EXACT = 2.0**53
_LOW, _HIGH = -(1 << 63), (1 << 63) - 1


class Lists:
    """The sorted lists of some rows, one list a component; queries read each from its top where their component is
    positive, else from its bottom."""

    def __init__(self, x: np.ndarray):
        self.x, self.sorted = x, np.sort(x, axis=0)

    def heads(self) -> tuple[np.ndarray, np.ndarray]:
        """Highest and lowest entry of each list: bounds of all rows before anything is read."""
        return self.sorted[-1], self.sorted[0]

    def read(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """What is known of each row when `depth` entries of every list have been read, from its top and from its bottom.

        An entry read is known as it is. One not read yet lies at or below the last entry read from the top (it
        counts as that in the upper bound, as the list's other end in the lower), and likewise from the bottom.
        Upper and lower form, each with the tops' columns before the bottoms'.
        """
        high, low = self.heads()
        top, bottom = self.sorted[len(self.x) - depth], self.sorted[depth - 1]
        upper = np.hstack([np.maximum(self.x, top), np.minimum(self.x, bottom)])
        lower = np.hstack([np.where(self.x >= top, self.x, low), np.where(self.x <= bottom, self.x, high)])
        return upper, lower


class Best:
    """The k best (score, row) of each query so far; equal scores go to the smaller row number."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.query = self.row = self.score = np.zeros(0, np.int64)
        self.least = np.full(queries, -np.inf)  # the k-th best score

    def add(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        query, row, score = np.concatenate([self.query, query]), np.concatenate([self.row, row]), np.concatenate([self.score, score])
        order = np.lexsort((row, ~score, query))
        query, row, score = query[order], row[order], score[order]
        first = np.searchsorted(query, query)
        place = np.arange(len(query)) - first
        keep = place < self.k
        self.query, self.row, self.score = query[keep], row[keep], score[keep]
        last = place[keep] == self.k - 1
        self.least[self.query[last]] = self.score[last]


def _resolve(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray, exact: bool) -> np.ndarray:
    """Scores of the pairs (i, j); beyond 64 bits they are held at the ends."""
    if not exact:
        return np.array([min(_HIGH, max(_LOW, sum(a * b for a, b in zip(q[a_].tolist(), x[b_].tolist())))) for a_, b_ in zip(i, j)], np.int64)
    out = np.zeros(len(i), np.int64)
    for a in range(0, len(i), _PAIRS):
        out[a : a + _PAIRS] = np.einsum("ij,ij->i", q[i[a : a + _PAIRS]], x[j[a : a + _PAIRS]])
    return out


def top_rows(q: np.ndarray, x: np.ndarray, k: int) -> Best:
    """The k rows of x of the highest inner product with each row of q (64-bit integers), ties to the smaller row number.

    Rows come in sets with sorted lists of their own. All lists of a set are read to the same depth; each
    (query, row) then has a lower and an upper score bound. The k-th best lower bound (or score of an
    earlier set) is what a row must be able to reach; rows that can't are closed. Reading stops once few
    pairs are open, and their final scores are resolved. A set whose heads can't reach it isn't read at all.
    """
    width, best = x.shape[1], Best(len(q), k)
    size = float(np.abs(x.astype(float)).max(initial=0)) * float(np.abs(q.astype(float)).max(initial=0)) * max(width, 1)
    exact = size < _EXACT
    slack = 0.0 if exact else size * 2.0**-40  # bounds are rounded where products leave 53 bits
    held = lambda b: b if exact else np.clip(b, _LOW, _HIGH)  # noqa: E731  as the scores are
    signed = np.hstack([np.maximum(q, 0), np.minimum(q, 0)]).astype(float)
    at, leaf = 0, FIRST_LEAF
    while at < len(x):
        lists = Lists(x[at : at + leaf].astype(float))
        n = len(lists.x)
        bounds = [lists.read(min(n, max(1, round(n * share)))) for share in DEPTHS]
        reach = held(signed @ np.concatenate(lists.heads()) + slack) >= best.least
        for a in range(0, len(q), TOGETHER):
            mine = a + np.flatnonzero(reach[a : a + TOGETHER])
            if not len(mine):
                continue
            least = best.least[mine]
            open_ = np.ones((len(mine), n), bool)
            for upper, lower in bounds:
                if n > k:
                    least = np.maximum(least, held(np.partition(signed[mine] @ lower.T, n - k, axis=1)[:, n - k] - slack))
                open_ &= held(signed[mine] @ upper.T + slack) >= least[:, None]
                if open_.mean() <= FEW:
                    break
            i, j = np.nonzero(open_)
            if exact and len(i) > FEW * open_.size:
                score = (q[mine].astype(float) @ lists.x.T)[i, j].astype(np.int64)
            else:
                score = _resolve(q[mine], x[at : at + n], i, j, exact)
            enough = score >= best.least[mine][i]
            best.add(mine[i[enough]], at + j[enough], score[enough])
        at, leaf = at + n, min(LEAF, 2 * leaf)
    return best


def _matrix(table: pa.Table) -> np.ndarray:
    column = table.column("x").combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _search(k: int):
    def work(rows: pa.Table, queries: pa.Table) -> pa.Table:
        types = [("query", pa.int64()), ("vec_id", pa.int64()), ("uid", pa.int64()), ("score", pa.int64())]
        if not len(rows) or not len(queries):
            return pa.schema(types).empty_table()
        rows = rows.sort_by([("vec_id", "ascending"), ("uid", "ascending")])  # nulls come last
        best = top_rows(_matrix(queries), _matrix(rows), k)
        found = rows.select(["vec_id", "uid"]).take(pa.array(best.row))
        return pa.table([queries.column("q").take(pa.array(best.query)), found.column("vec_id"), found.column("uid"), pa.array(best.score)], [n for n, _ in types])

    return work


def whole_numbers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, uid (a number of the row's own), x: components as floor(scale * x); null vectors and such with null or
    non-finite components go. Written once, so uid stays."""
    e = F.col("embedding").cast("array<double>")
    sound = F.forall(e, lambda c: c.isNotNull() & (F.abs(c) < float("inf")))
    x = F.transform(e, lambda c: F.floor(c * scale).cast("long"))
    return materialize(vectors.where(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.monotonically_increasing_id().alias("uid"), x.alias("x")), "vectors")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: int = SCALE, shard: int | None = None, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each query (rows whose vec_id is divisible by
    `every`) with all other rows of the same width, ties to the smaller vec_id (null last).

    Of equal vectors only the k + 1 of smallest vec_id can be among anyone's k best, so no more are looked
    at; equal queries are answered once, by k + 1 rows, of which each leaves itself out. Shards of rows
    meet blocks of queries, every pair in a task of its own (top_rows), and the best of all shards are
    merged. Work grows with distinct rows x distinct queries; rows are sent once for each block of queries.

    Rows that repeat a vec_id are rows of their own and candidates of each other. A null vec_id is no query.
    Empty vectors score 0 with each other. Components and scores beyond 64 bits are held at the ends. An empty
    table gives an empty result; other columns are not read.
    """
    all_rows = whole_numbers(vectors, scale)
    equal = Window.partitionBy("x").orderBy(F.col("vec_id").asc_nulls_last(), "uid")
    rows = materialize(all_rows.withColumn("_k", F.row_number().over(equal)).where(F.col("_k") <= k + 1).drop("_k"), "rows")
    asked = all_rows.where(F.col("vec_id") % every == 0)
    queries = materialize(asked.groupBy("x").agg(F.min("uid").alias("q")), "queries")
    n, m = rows.count(), queries.count()
    shards = max(1, round(n / (shard or min(SHARD, power_of_two(n / 16, 4096)))))
    blocks = max(1, round(m / (block or min(BLOCK, power_of_two(m / 4, 1024)))))
    place = lambda c, many: F.pmod(F.xxhash64(c), F.lit(many)).cast("int")
    each = lambda many: F.explode(F.sequence(F.lit(0), F.lit(many - 1)))
    sent = rows.select(F.size("x").alias("width"), place("uid", shards).alias("shard"), each(blocks).alias("block"), "vec_id", "uid", "x")
    put = queries.select(F.size("x").alias("width"), each(shards).alias("shard"), place("q", blocks).alias("block"), "q", "x")
    key = ["width", "shard", "block"]
    found = sent.groupBy(*key).cogroup(put.groupBy(*key)).applyInArrow(_search(k + 1), "query long, vec_id long, uid long, score long")
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last(), "uid")
    top = found.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= k + 1)
    best = top.groupBy(F.col("query").alias("q")).agg(F.array_sort(F.collect_list(F.struct("_k", "vec_id", "uid", "score"))).alias("best"))
    known = queries.join(best, "q").select("x", "best")
    mine = asked.join(known, "x").select(F.col("vec_id").alias("query_id"), F.slice(F.filter("best", lambda b: b["uid"] != F.col("uid")), 1, k).alias("best"))
    return mine.select("query_id", F.posexplode("best").alias("_i", "b")).select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), "b.vec_id", "b.score")


def op12_nra_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings"))


OP12_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as x from embeddings
  where embedding is not null and list_bool_and(list_transform(embedding, lambda x: x is not null and isfinite(x)))
), scored as (
  select q.vec_id as query_id, c.vec_id, list_inner_product(q.x, c.x)::bigint as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id != q.vec_id
), ranked as (
  select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
