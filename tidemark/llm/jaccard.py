"""Exact Jaccard self-join of documents on word shingles by universe partition and pigeonhole."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Chunks, materialize, power_of_two, read_table
from tidemark.llm.exchange import by_bucket, groups_of, join_binary
from tidemark.llm.graph import connected_components
from tidemark.llm.textarrays import column, hash_words, mix, release, runs, windows

SHINGLE = 5
#: Two documents link at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: A shingle in more than so many different sets is hot: segments of hot shingles alone aren't used.
HOT = 64
#: Segments for each difference that must be covered; the surplus pays for empty and hot segments.
SURPLUS = 1.3
#: Members of one block where a clique of hot sets is checked pair of blocks by pair of blocks.
BLOCK = 1000
BUCKET_BYTES = 1 << 24
_U = np.uint64


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE) -> list[np.ndarray]:
    """Each text's distinct k-word shingles as sorted 64-bit hashes; a shorter text's words make one."""
    hashes, counts = hash_words(data, offsets, lower=True)
    rolled, _ = windows(hashes, counts, k)
    ends = np.cumsum(np.maximum(counts - k + 1, 0))
    firsts, words = ends - np.maximum(counts - k + 1, 0), np.cumsum(counts) - counts
    sets = []
    for i, n in enumerate(counts):
        if n >= k:
            sets.append(np.unique(rolled[firsts[i] : ends[i]]))
        elif n:
            x = np.zeros(1, _U)
            for h in hashes[words[i] : words[i] + n]:
                x = mix(x * _U(3) + h)
            sets.append(x)
        else:
            sets.append(np.zeros(0, _U))
    return sets


def digest(tokens: np.ndarray) -> int:
    """A set's 64-bit identity."""
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def _ask(bits: int):
    """Distinct shingles of each run with the number of different sets that have them."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            different = {s.tobytes(): s for s in shingle_sets(*column(run.column("text")))}
            tokens, count = np.unique(np.concatenate([*different.values(), np.zeros(0, _U)]), return_counts=True)
            short, few = (tokens >> _U(32 - bits)).astype("<u4"), np.minimum(count, 255).astype(np.uint8)
            found = by_bucket(tokens, bits) or [(0, 0, 0)]
            rows = run.column("row").to_numpy()
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([run.column("chunk")[0].as_py()] * len(found), pa.int64()), "first_row": pa.array([int(rows[0])] * len(found), pa.int64()), "n_rows": pa.array([len(rows)] * len(found), pa.int32()),
                "bucket": pa.array([b for b, _, _ in found], pa.int32()), "keys": [short[a:b].tobytes() for _, a, b in found], "counts": [few[a:b].tobytes() for _, a, b in found],
            })

    return work


def _answer(hot: int):
    """0: one set has the shingle; 1: few have; 2: it is hot."""

    def work(table: pa.Table) -> pa.Table:
        keys, starts = join_binary(table.column("keys"), "<u4")
        counts, _ = join_binary(table.column("counts"), np.uint8)
        order, group = groups_of(keys)
        total = np.bincount(group, counts[order]) if len(group) else np.zeros(0)
        kind = np.zeros(len(keys), np.uint8)
        kind[order] = ((total > 1).astype(np.uint8) + (total > hot))[group] if len(group) else 0
        return table.select(["chunk", "first_row", "n_rows", "bucket"]).append_column("kinds", pa.array([kind[a:b].tobytes() for a, b in zip(starts, starts[1:])], pa.binary()))

    return work


_SETS = "chunk long, row long, doc_id long, n long, digest long, n_unique long, tokens binary, kinds binary"
_SET_TYPES = [pa.int64()] * 6 + [pa.binary()] * 2


def _describe(percent: int):
    """Each document's set size and identity; its shingles only where shared ones could make a link."""

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, out = docs.sort_by("row"), []
        answers = answers.sort_by([("first_row", "ascending"), ("bucket", "ascending")])
        rows, firsts = docs.column("row").to_numpy(), answers.column("first_row").to_numpy()
        for first in np.unique(firsts):
            mine = answers.filter(pa.array(firsts == first))
            part = docs.slice(int(np.searchsorted(rows, first)), mine.column("n_rows")[0].as_py())
            sets = shingle_sets(*column(part.column("text")))
            known = np.unique(np.concatenate([*sets, np.zeros(0, _U)]))
            kinds, _ = join_binary(mine.column("kinds"), np.uint8)
            for chunk, row, doc_id, s in zip(*(part.column(c).to_pylist() for c in ("chunk", "row", "doc_id")), sets):
                kind = kinds[np.searchsorted(known, s)]
                alone = int((kind == 0).sum())
                may = len(s) and 100 * (len(s) - alone) >= percent * len(s)
                out.append((chunk, row, doc_id, len(s), digest(s) if len(s) else None, alone, s.astype("<u8").tobytes() if may else None, kind.tobytes() if may else None))
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _SET_TYPES)] if out else [pa.array([], t) for t in _SET_TYPES], [x.split()[0] for x in _SETS.split(", ")])

    return work


def bands(size: int, percent: int = PERCENT) -> tuple[int, list[int]]:
    """The size's band, and the bands' lower bounds up to two beyond it: linked sets lie in one band or two neighbours."""
    lower = [1]
    while lower[-1] <= size:
        lower.append(lower[-1] * 100 // percent + 1)
    k = len(lower) - 2
    lower.append(lower[-1] * 100 // percent + 1)
    lower.append(lower[-1] * 100 // percent + 1)
    return k, lower


def signatures(tokens: np.ndarray, kinds: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, bool]:
    """A set's signature keys, and whether they leave links to other such sets unseen.

    For each pair of neighbouring size bands the universe is hashed into m segments. Two linked sets
    differ in H shingles at most, so each set must give segments that certainly differ or are indexed
    with allowances t adding up to more than H:
      -1 for segments that are empty or all hot (their lists would be long),
      a shingle no other set has: the segment differs for certain and costs no key,
       0 (exact content) for the others, one key,
      +1 (content and all one-deletion variants that keep a cold shingle), only if those don't suffice.
    Variants cost a key for each shingle, so they are given in as few segments as reach the sum, always the first
    ones: of two linked sets one needs no more of them than the other, and where it has variants the other has them too.
    """
    size, out, rest = len(tokens), [], False
    k, lower = bands(size, percent)
    content = mix(tokens ^ _U(0xA24BAED4963EE407))
    alone, cold = kinds == 0, kinds == 1
    for g in (k - 1, k):
        if g < 0:
            continue
        small = lower[g + 1] - 1
        most = (small + min(small * 100 // percent, lower[g + 2] - 1)) * (100 - percent) // (100 + percent)
        partner = min(size * 100 // percent, lower[g + 2] - 1)
        needed = (size + partner) * (100 - percent) // (100 + percent) + 1
        m = int(np.ceil(SURPLUS * (most + 1)))
        segment = ((tokens >> _U(17)) % _U(m)).astype(np.int64)
        n_alone, n_cold = np.bincount(segment, alone, m), np.bincount(segment, cold, m)
        sums = np.zeros(m, _U)
        np.add.at(sums, segment, content)
        salt = mix(np.arange(m, dtype=np.uint64) + _U(1_000_003 * (g + 1)))
        exact = (n_alone == 0) & (n_cold > 0)
        out.append(mix(sums[exact] + salt[exact]))
        weight = int(n_alone.sum() + exact.sum())
        if weight < needed:  # allow one difference in as many of the first segments as it takes
            twice, single = exact & (n_cold > 1), (n_alone == 1) & (n_cold > 0)
            gained = np.cumsum(twice | single)
            upto = int(np.searchsorted(gained, needed - weight)) + 1
            drop = (twice[segment] | (single[segment] & alone)) & (segment < upto)
            out.append(mix(sums[segment[drop]] - content[drop] + salt[segment[drop]]))
            rest |= weight + int(gained[-1]) < needed
    return np.unique(np.concatenate(out)) if out else np.zeros(0, _U), rest


def _index(percent: int, bits: int):
    """Packed signature keys by bucket, and the sets that need the other way (bucket -1, their prefix shingles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 1000) for b in batches for k in range(0, b.num_rows, 1000)):
            ids, sizes = batch.column("digest").to_pylist(), batch.column("n").to_pylist()
            keys, owners, ns, rest = [], [], [], []
            for i, n, t, kd in zip(ids, sizes, batch.column("tokens").to_pylist(), batch.column("kinds").to_pylist()):
                tokens, kinds = np.frombuffer(t, "<u8"), np.frombuffer(kd, np.uint8)
                found, unseen = signatures(tokens, kinds, percent)
                keys.append(found)
                owners.append(np.full(len(found), i, np.int64))
                ns.append(np.full(len(found), n, np.int32))
                if unseen:
                    order = np.lexsort((tokens, kinds))[: n - (percent * n + 99) // 100 + 1]
                    prefix = tokens[order[kinds[order] > 0]]
                    rest.append((i, n, prefix.astype("<u8").tobytes()))
            key, owner, size = np.concatenate(keys), np.concatenate(owners), np.concatenate(ns)
            order = np.argsort(key, kind="stable")
            key, owner, size = key[order], owner[order], size[order]
            parts = by_bucket(key, bits)
            yield pa.RecordBatch.from_pydict({
                "bucket": pa.array([b for b, _, _ in parts] + [-1] * len(rest), pa.int32()),
                "keys": pa.array([key[a:b].astype("<u8").tobytes() for _, a, b in parts] + [r[2] for r in rest], pa.binary()),
                "owners": pa.array([owner[a:b].astype("<i8").tobytes() for _, a, b in parts] + [np.array([r[0]], "<i8").tobytes() for r in rest], pa.binary()),
                "sizes": pa.array([size[a:b].astype("<i4").tobytes() for _, a, b in parts] + [np.array([r[1]], "<i4").tobytes() for r in rest], pa.binary()),
            })

    return work


def _pairs(percent: int):
    """Different sets with one key in common whose sizes allow a link, each pair once a bucket."""

    def work(table: pa.Table) -> pa.Table:
        keys, _ = join_binary(table.column("keys"), "<u8")
        owners, _ = join_binary(table.column("owners"), "<i8")
        sizes, _ = join_binary(table.column("sizes"), "<i4")
        order = np.lexsort((owners, keys))
        keys, owners, sizes = keys[order], owners[order], sizes[order]
        found, reach = [], 1
        at = np.arange(len(keys))
        while True:  # partners one place further on, until no list is that long
            at = at[at + reach < len(keys)]
            at = at[keys[at] == keys[at + reach]]
            if not len(at):
                break
            a, b = owners[at], owners[at + reach]
            fits = (a != b) & (100 * np.minimum(sizes[at], sizes[at + reach]) >= percent * np.maximum(sizes[at], sizes[at + reach]))
            found.append(np.unique(np.stack([a[fits], b[fits]], 1), axis=0))
            reach += 1
        pairs = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0], pa.int64()), "b": pa.array(pairs[:, 1], pa.int64())})

    return work


def linked(x: np.ndarray, y: np.ndarray, percent: int = PERCENT) -> bool:
    """The exact test on two sorted sets."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _verify(percent: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [linked(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), percent) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return work


def _check_blocks(percent: int):
    """Links within a clique's pair of blocks: a spanning forest and no more."""

    def work(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("digest").sort_values("n").reset_index(drop=True)
        n, ids = pdf["n"].to_numpy(), pdf["digest"].to_numpy()
        sets = [np.frombuffer(t, "<u8") for t in pdf["tokens"]]
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        starts = np.concatenate(([0], np.cumsum(n)))[:-1]
        label, edges, seen = np.arange(len(ids)), [], np.zeros(int(flat.max()) + 1, bool)
        for i in range(len(ids)):
            to = int(np.searchsorted(n, n[i] * 100 // percent, "right"))
            other = np.flatnonzero(label[i + 1 : to] != label[i]) + i + 1
            if not len(other):
                continue
            seen[:] = False
            seen[flat[starts[i] : starts[i] + n[i]]] = True
            a, b = starts[i + 1], (starts[to] if to < len(starts) else len(flat))
            both = np.add.reduceat(seen[flat[a:b]].astype(np.int64), starts[i + 1 : to] - a)[other - i - 1]
            for j in other[100 * both >= percent * (n[i] + n[other] - both)]:
                if label[i] != label[j]:
                    edges.append((ids[i], ids[j]))
                    label[label == label[j]] = label[i]
        return pd.DataFrame(edges, columns=["a", "b"])

    return work


def _rest_links(rest: DataFrame, classes: DataFrame, percent: int, block: int) -> DataFrame:
    """Exact links among sets made of hot shingles: sets that share a prefix shingle form a clique.

    Shingles with the same members are one clique; cliques are checked in pairs of blocks, and a pair of
    blocks returns a spanning forest of its links. No member is left out, no group exceeds two blocks.
    """

    def explode_prefix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, owner in zip(batch.column("keys").to_pylist(), batch.column("owners").to_pylist()):
                t = np.frombuffer(keys, "<i8")
                yield pa.RecordBatch.from_pydict({"token": pa.array(t, pa.int64()), "digest": pa.array(np.full(len(t), np.frombuffer(owner, "<i8")[0]), pa.int64())})

    members = materialize(rest.mapInArrow(explode_prefix, "token long, digest long"), "prefixes")
    # a clique's identity: order-free checksums of its members, so equal member lists meet once
    mark = F.xxhash64("digest", F.lit(1)).cast("decimal(20,0)")
    lists = members.groupBy("token").agg(F.count("*").alias("k"), F.sum(mark).alias("s"), F.sum(F.xxhash64("digest", F.lit(2)).cast("decimal(20,0)")).alias("q")).where("k > 1")
    cliques = lists.groupBy("k", "s", "q").agg(F.min("token").alias("token")).select("token", F.ceil(F.col("k") / block).cast("int").alias("blocks"))
    mine = F.pmod(F.xxhash64("digest", F.lit(3)), F.col("blocks")).cast("int")
    placed = members.join(cliques, "token").withColumn("i", mine)
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("token", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "digest")
    full = placed.join(classes.select("digest", "n", "tokens"), "digest")
    return full.groupBy("token", "i", "j").applyInPandas(_check_blocks(percent), "a long, b long")


def jaccard_groups(docs: DataFrame | Chunks, percent: int = PERCENT, hot: int = HOT, bucket_bytes: int = BUCKET_BYTES, block: int = BLOCK) -> DataFrame:
    """Every document with its shingle-set size and the smallest doc_id reachable by links.

    Sets: distinct 5-word shingles after lower-casing A-Z; a text of fewer words is one shingle; no words,
    no set and no links. Links are exact: candidates come from signatures() or, for sets made of hot
    shingles, from _rest_links(), and each is verified on the whole sets. Equal sets form one class and
    are joined once. Shingles and sets are compared by 64-bit hashes.

    Null texts count as empty. A null doc_id never becomes a component's id unless all its members are
    null. Repeated rows are members like others. An empty table gives an empty result; other columns are
    not read. Also returned: chunk, row (the document's address) and label, which is the component's
    own whatever its doc_ids (null: no words).
    """
    chunks = Chunks(docs) if isinstance(docs, DataFrame) else docs
    pieces, bits = chunks.rows, power_of_two(chunks.size / bucket_bytes).bit_length() - 1
    asked = pieces.mapInArrow(_ask(bits), "chunk long, first_row long, n_rows int, bucket int, keys binary, counts binary")
    answers = materialize(asked.groupBy("bucket").applyInArrow(_answer(hot), "chunk long, first_row long, n_rows int, bucket int, kinds binary"), "answers")
    sets = materialize(pieces.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_describe(percent), _SETS), "sets")
    classes = materialize(sets.where("tokens is not null").groupBy("digest").agg(F.first("n").alias("n"), F.first("tokens").alias("tokens"), F.first("kinds").alias("kinds")), "classes")
    few = max(0, bits - 4)  # signature keys are less than an eighth of the shingles; a pair is found once a bucket
    index = materialize(classes.mapInArrow(_index(percent, few), "bucket int, keys binary, owners binary, sizes binary"), "index")
    pairs = materialize(index.where("bucket >= 0").groupBy("bucket").applyInArrow(_pairs(percent), "a long, b long").distinct(), "pairs")
    tokens = classes.select("digest", "tokens")
    both = pairs.join(tokens.toDF("a", "x"), "a").join(tokens.toDF("b", "y"), "b").select("a", "b", "x", "y")
    links = both.mapInArrow(_verify(percent), "a long, b long").unionByName(_rest_links(index.where("bucket < 0"), classes, percent, block))
    labels = connected_components(materialize(links, "links"))
    least = sets.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    class_label = least.join(labels.toDF("digest", "label"), "digest", "left").withColumn("label", F.coalesce("label", "digest"))
    lowest = class_label.groupBy("label").agg(F.min("least").alias("component_id"))
    of_class = class_label.join(lowest, "label").select("digest", "component_id", "label")
    joined = sets.select("chunk", "row", "doc_id", "n", "digest").join(of_class, "digest", "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), "chunk", "row", "label")


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(read_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


OP9_SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words from documents
), sh as (
  select distinct doc_id, h from (
    select doc_id, md5(array_to_string(words[s:s + 4], ' ')) as h
    from (select doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) as s from w where len(words) > 0)
  )
), n as (select doc_id, count(*) as n from sh group by doc_id
), pair as (
  select a.doc_id as x, b.doc_id as y, count(*) as inter from sh a join sh b using (h) where a.doc_id < b.doc_id group by all
), link as (
  select x, y from pair join n a on a.doc_id = x join n b on b.doc_id = y where 100 * inter >= 75 * (a.n + b.n - inter)
), edge as (select x, y from link union all select y, x from link
), reach(doc_id, other) as (
  select doc_id, doc_id from w union select r.doc_id, e.y from reach r join edge e on e.x = r.other
)
select w.doc_id, coalesce(any_value(n.n), 0)::bigint as n_shingles, min(other) as component_id
from w left join n using (doc_id) join reach using (doc_id) group by w.doc_id
"""
