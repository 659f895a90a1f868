"""Trie of conversation prefixes: a count-min screen of prefix digests, exact grouping of what may be shared."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scan import following, mixed, previous, scan, total
from tidemark.llm.common import address, materialize, power_of_two, read_table
from tidemark.llm.exchange import BUCKET_KEYS, by_bucket, groups_of, join_binary, unpack
from tidemark.llm.textarrays import runs

#: Conversations of one block share their first turns with the block's first conversation.
GROUP = 100
#: A conversation takes over fewer than so many turns.
BORROWED = 6
#: Turns of a conversation that one task orders.
STRIDE = 256
#: Cells of each of the sketch's two rows, for each prefix; cells are spread over buckets, so the sketch has no size limit.
CELLS = 8
_NODE = ["depth", "p1", "p2"]


def own_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), digest, chars of each turn: null turns first, equal ones in the order of their digests.

    The digest is the md5 of role and text, chars the text's code points; texts go no further.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    t = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    return scan(t, ["conv_id"], ["turn", "digest"], F.floor(F.col("turn") / STRIDE), {"pos": total()}).select("conv_id", "pos", "digest", "chars")


def rebuilt(own: DataFrame, group: int = GROUP, borrowed: int = BORROWED) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, n_turns) and turns (conv_id, depth, digest, chars, n_turns) after the first h turns of each
    are replaced by those of its block's first conversation (fewer if that has fewer); h is crc32(conv_id) % borrowed."""
    sizes = own.groupBy("conv_id").agg(F.count("*").alias("size"))
    at = sizes.select("conv_id", "size", (F.col("conv_id") - F.col("conv_id") % group).alias("base"), (F.crc32(F.col("conv_id").cast("string")) % borrowed).alias("h"))
    at = at.join(sizes.select(F.col("conv_id").alias("base"), F.col("size").alias("base_size")), "base", "left")
    at = at.withColumn("taken", F.least("h", F.coalesce("base_size", F.lit(0))))
    convs = materialize(at.withColumn("n_turns", F.col("taken") + F.greatest(F.col("size") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "n_turns"), "conversations")
    heads = own.where(F.col("pos") < borrowed).select(F.col("conv_id").alias("base"), "pos", "digest", "chars")
    first = convs.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "digest", "chars", "n_turns")
    rest = own.join(convs, "conv_id").where("pos > h").select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "digest", "chars", "n_turns")
    return convs.select("conv_id", "n_turns"), first.unionByName(rest)


def _lanes(seed: int) -> list[Column]:
    return [F.xxhash64(F.lit(seed), "depth", "digest"), F.xxhash64("digest", "depth", F.lit(~seed))]


def prefixes(turns: DataFrame, seed: int) -> DataFrame:
    """turns with p1, p2: 128 bits of the sequence up to each turn."""
    one, two = _lanes(seed)
    return scan(turns, ["conv_id"], ["depth"], F.floor(F.col("depth") / STRIDE), {"p1": mixed(one), "p2": mixed(two)})


def _cells(batch: pa.Table, width: int) -> list[np.ndarray]:
    """The cells of each prefix in the sketch's two rows; the lowest bit tells the rows apart."""
    top = np.uint64(64 - width)
    return [(batch.column(c).to_numpy().view(np.uint64) >> top << top) + np.uint64(k) for k, c in enumerate(("c1", "c2"))]


def _count(width: int, bits: int):
    """A chunk's cells with their counts (1 or more), packed by bucket."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            cells, count = np.unique(np.concatenate(_cells(run, width)), return_counts=True)
            found = by_bucket(cells, bits)
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([run.column("chunk")[0].as_py()] * len(found), pa.int64()), "first_row": pa.array([run.column("row")[0].as_py()] * len(found), pa.int64()), "n_rows": pa.array([len(run)] * len(found), pa.int32()),
                "bucket": pa.array([b for b, _, _ in found], pa.int32()), "cells": [cells[a:b].tobytes() for _, a, b in found], "many": [np.packbits(count[a:b] > 1).tobytes() for _, a, b in found],
            })

    return work


def _ones(table: pa.Table) -> pa.Table:
    """Which cells count one in all."""
    cells, starts = join_binary(table.column("cells"), np.uint64)
    many = np.concatenate([unpack(m, int(n)) for m, n in zip(table.column("many").to_pylist(), np.diff(starts))] or [np.zeros(0, bool)])
    order, group = groups_of(cells)
    one = np.zeros(len(cells), bool)
    if len(cells):
        one[order] = (np.bincount(group, 1 + many[order]) == 1)[group]
    return table.select(["chunk", "first_row", "n_rows", "bucket"]).append_column("ones", pa.array([np.packbits(one[a:b]).tobytes() for a, b in zip(starts, starts[1:])], pa.binary())).append_column("n", pa.array(np.diff(starts), pa.int32()))


def _screen(width: int):
    """conv_id, depth of the prefixes whose estimate is one."""

    def work(rows: pa.Table, ones: pa.Table) -> pa.Table:
        rows, ones, out = rows.sort_by("row"), ones.sort_by([("first_row", "ascending"), ("bucket", "ascending")]), []
        firsts, at = ones.column("first_row").to_numpy(), rows.column("row").to_numpy()
        for first in np.unique(firsts):
            mine = ones.filter(pa.array(firsts == first))
            part = rows.slice(int(np.searchsorted(at, first)), mine.column("n_rows")[0].as_py())
            one, two = _cells(part, width)
            known = np.unique(np.concatenate([one, two]))
            single = np.concatenate([unpack(m, n) for m, n in zip(mine.column("ones").to_pylist(), mine.column("n").to_pylist())])
            out.append(part.filter(pa.array(single[np.searchsorted(known, one)] | single[np.searchsorted(known, two)])).select(["conv_id", "depth"]))
        return pa.concat_tables(out) if out else rows.slice(0, 0).select(["conv_id", "depth"])

    return work


def first_alone(known: DataFrame, cells: int = CELLS) -> DataFrame:
    """conv_id, alone: the least depth at which the sketch proves that nobody else has the conversation's prefix.

    An estimate is the smaller of a prefix's two cells and never too low, so one proves a singleton. Chunks
    send their distinct cells once, packed by bucket; each bucket adds them up and answers in bits.
    """
    n = known.count()
    width = power_of_two(cells * max(n, 1)).bit_length() - 1
    bits = power_of_two(2 * n / BUCKET_KEYS).bit_length() - 1
    rows = known.select(*address(), "conv_id", "depth", F.xxhash64(*_NODE).alias("c1"), F.xxhash64(*reversed(_NODE)).alias("c2"))
    asked = rows.mapInArrow(_count(width, bits), "chunk long, first_row long, n_rows int, bucket int, cells binary, many binary")
    ones = asked.groupBy("bucket").applyInArrow(_ones, "chunk long, first_row long, n_rows int, bucket int, ones binary, n int")
    single = rows.groupBy("chunk").cogroup(ones.groupBy("chunk")).applyInArrow(_screen(width), "conv_id long, depth long")
    return single.groupBy("conv_id").agg(F.min("depth").alias("alone"))


def _joined_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids, which come in order; a node's ids go by, they aren't held."""
    at, digest = None, None
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        rows = [[*n, d] for n, d in done]
        done.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate([pa.int64()] * 3 + [pa.string()])], [*_NODE, "ends_sha256"])

    for batch in batches:
        depth, p1, p2, ids = (c.to_numpy() for c in batch.columns)
        new = np.ones(len(ids), bool)
        new[1:] = (depth[1:] != depth[:-1]) | (p1[1:] != p1[:-1]) | (p2[1:] != p2[:-1])
        cuts = [*np.flatnonzero(new).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            node, text = (int(depth[a]), int(p1[a]), int(p2[a])), ",".join(map(str, ids[a:b].tolist())).encode()
            if node == at:
                digest.update(b"," + text)
                continue
            if at is not None:
                done.append((at, digest.hexdigest()))
            at, digest = node, hashlib.sha256(text)
        if done:
            yield flush()
    if at is not None:
        done.append((at, digest.hexdigest()))
        yield flush()


def trie(conversations: DataFrame, group: int = GROUP, borrowed: int = BORROWED, cells: int = CELLS) -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256.

    1. Turns become digests, and each prefix 128 bits of a running value (a long conversation is cut into
       strides). 2. A count-min sketch of all prefixes screens them: from a conversation's first prefix
       with an estimate of one on, its nodes are its own and are told on the spot (a tail). 3. Prefixes
       that may be shared are grouped exactly, by depth and 128 bits. Were one group to hold two different
       last turns, everything would be digested anew under another seed; since parents are checked too,
       equal bits then mean equal turns. 4. A node's values are told once, by its smallest member; summed
       from a conversation's end to each depth and then over a node's members they give its subtree.

    Rows without conv_id belong to no conversation; a null role or text counts as empty, null turns come
    first, repeated rows are turns of their own, equal turn numbers follow their digests. conv_id % 100
    has the sign of conv_id. Without conversations there is no root: an empty table gives an empty
    result. Ids that end in one node go through one task in order, held never more than a batch. Other columns are not read.
    """
    convs, turns = rebuilt(materialize(own_turns(conversations), "turns"), group, borrowed)
    seed = 0
    while True:
        known = materialize(prefixes(turns, seed), "prefixes")
        alone = materialize(first_alone(known, cells), "alone")
        with_first = lambda df: df.join(alone, "conv_id", "left").withColumn("alone", F.coalesce("alone", F.col("n_turns") + 1))
        placed = with_first(known)
        zero = F.lit(0).cast("long")
        roots = with_first(convs).select("conv_id", zero.alias("depth"), F.lit("").alias("digest"), zero.alias("chars"), "n_turns", zero.alias("p1"), zero.alias("p2"), "alone")
        sent = materialize(placed.where("depth < alone").unionByName(roots), "sent")
        nodes = sent.groupBy(*_NODE).agg(F.min("conv_id").alias("rep"), F.count("*").alias("n_convs"), F.count_if(F.col("depth") == F.col("n_turns")).alias("n_ends"), F.min("digest").alias("_a"), F.max("digest").alias("_b"))
        nodes = materialize(nodes, "nodes")
        if nodes.where("_a != _b").isEmpty():
            break
        seed += 1
    members = sent.join(nodes.drop("_a", "_b"), _NODE)
    tail = (F.col("depth") == F.col("alone") - 1) & (F.col("alone") <= F.col("n_turns"))
    mine = F.col("conv_id") == F.col("rep")
    leaf = (mine & (F.col("n_ends") == F.col("n_convs"))).cast("long") + tail.cast("long")
    members = members.withColumns({"tail": tail, "up": -F.col("depth"), "_saved": F.when(mine, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0), "_leaf": leaf})
    walked = scan(members, ["conv_id"], ["up"], F.floor(F.col("up") / STRIDE), {"saved": total("_saved"), "leaves": total("_leaf"), "deeper": previous("rep"), "parent": following("rep")})
    walked = materialize(walked.select("conv_id", *_NODE, "rep", "n_convs", "n_turns", "tail", "saved", "leaves", F.coalesce(F.col("deeper.rep") == F.col("conv_id"), F.lit(False)).alias("child"), F.col("parent.rep").alias("parent")), "walked")
    shared = walked.groupBy(*_NODE).agg(
        F.min("rep").alias("conv_id"), F.min("parent").alias("parent_conv_id"), F.max("n_convs").alias("n_convs"), F.count_if(F.col("child") | F.col("tail")).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens")
    )
    ends = walked.where("depth = n_turns").select(*_NODE, "conv_id").repartition(*_NODE).sortWithinPartitions(*_NODE, "conv_id")
    hashed = ends.mapInArrow(_joined_hash, "depth long, p1 long, p2 long, ends_sha256 string")
    nothing = F.sha2(F.lit("").cast("binary"), 256)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    top = shared.join(hashed, _NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", nothing)).select(*columns)
    above = walked.where("tail").select("conv_id", (F.col("depth") + 1).alias("depth"), F.col("rep").alias("above"))
    own = placed.where("depth >= alone").select("conv_id", "depth", "n_turns").join(above, ["conv_id", "depth"], "left")
    one = F.lit(1).cast("long")
    tails = own.select(
        "conv_id", "depth", F.coalesce("above", "conv_id").alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("n_turns")).cast("long").alias("n_children"), one.alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(F.col("depth") == F.col("n_turns"), F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(nothing).alias("ends_sha256"),
    )
    return top.unionByName(tails)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read_table(spark, sf_dir, "conversations"))


OP13_SQL = """
with ordered as (
  select conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars, turn
  from conversations where conv_id is not null
), own as (
  select conv_id, list({'digest': digest, 'chars': chars} order by turn nulls first, digest) as turns from ordered group by conv_id
), begun as (
  select conv_id, turns, conv_id - conv_id % 100 as base,
    xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint)),
      lambda a, b: list_reduce(list_prepend(xor(a, b), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]), lambda r, z: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) % 6 as h
  from own
), made as (
  select begun.conv_id, list_concat(coalesce(b.turns, [])[1:h], begun.turns[h + 1:]) as turns from begun left join own b on b.conv_id = begun.base
), pre as (
  select conv_id, turns, unnest(range(0, len(turns) + 1)) as depth from made
), keyed as (
  select conv_id, depth, len(turns) = depth as ends, case when depth > 0 then turns[depth].chars else 0 end as chars,
    array_to_string(list_transform(turns[1:depth], lambda x: x.digest), '') as path from pre
), nodes as (
  select depth, path, min(conv_id) as conv_id, count(*) as n_convs, any_value(chars) as chars,
    sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256 from keyed group by depth, path
), linked as (
  select n.*, p.conv_id as parent_conv_id, (select count(*) from nodes c where c.depth = n.depth + 1 and left(c.path, 32 * n.depth) = n.path) as n_children
  from nodes n left join nodes p on p.depth = n.depth - 1 and p.path = left(n.path, 32 * n.depth - 32)
)
select a.conv_id, a.depth, any_value(a.parent_conv_id) as parent_conv_id, any_value(a.n_convs) as n_convs, any_value(a.n_children) as n_children,
  count(*) filter (where b.n_children = 0) as n_leaves, sum((b.n_convs - 1) * b.chars)::bigint as saved_tokens, any_value(a.ends_sha256) as ends_sha256
from linked a join linked b on b.depth >= a.depth and left(b.path, 32 * a.depth) = a.path
group by a.conv_id, a.depth, a.path
"""
