"""Exact repeats of word windows across a corpus, found from fixed-block anchors, and their removal."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Chunks, materialize, power_of_two, read_table
from tidemark.llm.exchange import by_bucket, groups_of, join_binary, unpack
from tidemark.llm.textarrays import column, hash_words, release, runs, windows

WINDOW = 20
#: Bytes of text meant for one bucket of anchors, and for one of windows.
BUCKET_BYTES = 1 << 24
_NULL_ID = -(1 << 63)
_SPANS = "array<struct<start: long, end: long>>"


def _anchors(hashes: np.ndarray, counts: np.ndarray, block: int, bits: int):
    """Distinct keys of all rolling block-word windows of a run, whether each is ever an aligned block or
    occurs twice, and for each window (by start) the place of its key."""
    rolled, starts = windows(hashes, counts, block)
    keys = rolled >> np.uint64(32 - bits) << np.uint64(32 - bits)  # the bucket's bits and 32 more
    unique, place, number = np.unique(keys, return_inverse=True, return_counts=True)
    first = np.cumsum(counts) - counts
    in_doc = starts - np.repeat(first, np.maximum(counts - block + 1, 0))
    aligned = np.zeros(len(unique), bool)
    aligned[place[in_doc % block == 0]] = True
    return unique, aligned, number > 1, place, starts


def _probe(block: int, bits: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            data, offsets = column(run.column("text"))
            hashes, counts = hash_words(data, offsets)
            unique, aligned, twice, _, _ = _anchors(hashes, counts, block, bits)
            short = (unique >> np.uint64(32 - bits)).astype("<u4")
            found = by_bucket(unique, bits)
            rows = run.column("row").to_numpy()
            at = (run.column("chunk")[0].as_py(), int(rows[0]), len(rows))
            if not found:  # runs without windows still tell their extent
                found = [(0, 0, 0)]
            yield pa.RecordBatch.from_pydict({
                "chunk": pa.array([at[0]] * len(found), pa.int64()), "first_row": pa.array([at[1]] * len(found), pa.int64()), "n_rows": pa.array([at[2]] * len(found), pa.int32()),
                "bucket": pa.array([b for b, _, _ in found], pa.int32()), "keys": [short[a:b].tobytes() for _, a, b in found],
                "flags": [(aligned[a:b] + 2 * twice[a:b]).astype(np.uint8).tobytes() for _, a, b in found],
            })

    return work


def _hits(table: pa.Table) -> pa.Table:
    """Marks keys that are an aligned block somewhere and occur at least twice."""
    keys, starts = join_binary(table.column("keys"), "<u4")
    flags, _ = join_binary(table.column("flags"), np.uint8)
    order, group = groups_of(keys)
    n = int(group[-1]) + 1 if len(group) else 0
    many = np.bincount(group, minlength=n) + np.bincount(group, flags[order] >> 1, n) > 1
    anchored = np.bincount(group, flags[order] & 1, n) > 0
    marked = np.zeros(len(keys), bool)
    marked[order] = (many & anchored)[group]
    masks = [np.packbits(marked[a:b]).tobytes() for a, b in zip(starts, starts[1:])]
    return table.select(["chunk", "first_row", "n_rows", "bucket"]).append_column("mask", pa.array(masks, pa.binary())).append_column("n", pa.array(np.diff(starts), pa.int32()))


def _sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


_EXTENDED = (
    "kind string, chunk long, first_row long, row long, doc_id long, n_words long, text binary, candidates binary, kept_sha256 string, bucket int, keys binary, ids binary"
)
_TYPES = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.string(), pa.int32(), pa.binary(), pa.binary()]
_NAMES = [x.split()[0] for x in _EXTENDED.split(", ")]


def _earliest(hashes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes (sorted), the index of each one's earliest window by (id, order), and each window's place."""
    order = np.lexsort((np.arange(len(hashes)), ids, hashes))
    h = hashes[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    place = np.zeros(len(h), np.int64)
    place[order] = np.cumsum(new) - 1
    return h[new], order[new], place


def _extend(window: int, block: int, bits: int):
    """Cuts a chunk's documents down to windows that touch a hit, and sends their hashes on."""

    def work(docs: pa.Table, hits: pa.Table) -> pa.Table:
        docs, out = docs.sort_by("row"), []
        hits = hits.sort_by([("first_row", "ascending"), ("bucket", "ascending")])
        rows, firsts = docs.column("row").to_numpy(), hits.column("first_row").to_numpy()
        for first in np.unique(firsts):
            mine = hits.filter(pa.array(firsts == first))
            a = int(np.searchsorted(rows, first))
            part = docs.slice(a, mine.column("n_rows")[0].as_py())
            out += _extend_run(part, int(first), mine, window, block, bits)
        release()
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _TYPES)] if out else [pa.array([], t) for t in _TYPES], _NAMES)

    return work


def _extend_run(part: pa.Table, first: int, mine: pa.Table, window: int, block: int, bits: int) -> list[tuple]:
    chunk = part.column("chunk")[0].as_py()
    data, offsets = column(part.column("text"))
    hashes, counts = hash_words(data, offsets)
    _, _, _, place, starts = _anchors(hashes, counts, block, bits)
    marks = np.concatenate([unpack(m, n) for m, n in zip(mine.column("mask").to_pylist(), mine.column("n").to_pylist())] or [np.zeros(0, bool)])
    hit = np.zeros(len(hashes) + 1, np.int64)
    if len(starts):
        hit[starts + 1] = marks[place]
    hit = np.cumsum(hit)  # hits that start before a word
    whole, at = windows(hashes, counts, window)
    near = hit[at + window - block + 1] > hit[at]
    whole, at = whole[near], at[near]
    ends = np.cumsum(counts)
    doc = np.searchsorted(ends, at, "right")
    ids = np.array([_NULL_ID if x is None else x for x in part.column("doc_id").to_pylist()], np.int64)
    unique, earliest, _ = _earliest(whole, ids[doc])
    owner = ids[doc[earliest]] if len(unique) else np.zeros(0, np.int64)
    out: list[tuple] = [("window", chunk, first, None, None, None, None, None, None, b, unique[i:j].astype("<u8").tobytes(), owner[i:j].astype("<i8").tobytes()) for b, i, j in by_bucket(unique, bits)]
    has, raw = np.bincount(doc, minlength=len(counts)) > 0, data.tobytes()
    bounds = np.searchsorted(doc, np.arange(len(counts) + 1))
    for k, (row, doc_id) in enumerate(zip(part.column("row").to_pylist(), part.column("doc_id").to_pylist())):
        text = raw[offsets[k] : offsets[k + 1]]
        if has[k]:
            inner = np.zeros(int(counts[k]), bool)
            inner[at[bounds[k] : bounds[k + 1]] - (ends[k] - counts[k])] = True
            out.append(("document", chunk, first, row, doc_id, int(counts[k]), text, np.packbits(inner).tobytes(), None, None, None, None))
        else:
            out.append(("document", chunk, first, row, doc_id, int(counts[k]), None, None, _sha(text.split()), None, None, None))
    return out


def _judge(table: pa.Table) -> pa.Table:
    """Which sender's window is the corpus's first: by document, then by place."""
    keys, starts = join_binary(table.column("keys"), "<u8")
    ids, _ = join_binary(table.column("ids"), "<i8")
    sender = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    rank = np.lexsort((table.column("first_row").to_numpy(), table.column("chunk").to_numpy()))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    order = np.lexsort((place[sender], ids, keys))
    k = keys[order]
    new = np.ones(len(k), bool)
    new[1:] = k[1:] != k[:-1]
    won = np.zeros(len(keys), bool)
    won[order[new]] = True
    masks = [np.packbits(won[a:b]).tobytes() for a, b in zip(starts, starts[1:])]
    return table.select(["chunk", "first_row", "bucket"]).append_column("mask", pa.array(masks, pa.binary())).append_column("n", pa.array(np.diff(starts), pa.int32()))


def _remove(window: int):
    """Removes the words of windows that are not the corpus's first."""

    def work(docs: pa.Table, judged: pa.Table) -> pa.Table:
        docs, judged = docs.sort_by("row"), judged.sort_by("bucket")
        data, offsets = column(docs.column("text"))
        hashes, counts = hash_words(data, offsets)
        whole, at = windows(hashes, counts, window)
        chosen = np.concatenate([unpack(c, int(n)) for c, n in zip(docs.column("candidates").to_pylist(), counts)])[at]
        whole, at = whole[chosen], at[chosen]
        doc = np.searchsorted(np.cumsum(counts), at, "right")
        ids = np.array([_NULL_ID if x is None else x for x in docs.column("doc_id").to_pylist()], np.int64)
        _, earliest, _ = _earliest(whole, ids[doc])
        won = np.concatenate([unpack(m, n) for m, n in zip(judged.column("mask").to_pylist(), judged.column("n").to_pylist())])
        late = np.ones(len(at), bool)
        late[earliest[won]] = False
        edge = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(edge, at[late], 1)
        np.add.at(edge, at[late] + window, -1)
        keep = np.cumsum(edge)[:-1] == 0
        raw, first = data.tobytes(), np.cumsum(counts) - counts
        texts, removed, spans = [], [], []
        for k, n in enumerate(counts):
            mine = keep[first[k] : first[k] + n]
            removed.append(int(n - mine.sum()))
            ends = np.flatnonzero(np.diff(np.concatenate(([True], mine, [True])))).reshape(-1, 2)  # where kept words end and begin again
            spans.append([{"start": int(i), "end": int(j)} for i, j in ends])
            texts.append(b" ".join(compress(raw[offsets[k] : offsets[k + 1]].split(), mine.tolist())))
        return pa.table({
            "chunk": docs.column("chunk"), "row": docs.column("row"), "doc_id": docs.column("doc_id"), "n_words": docs.column("n_words"), "n_removed": pa.array(removed, pa.int64()),
            "kept_sha256": [hashlib.sha256(t).hexdigest() for t in texts], "kept_text": pa.array([t if n else None for t, n in zip(texts, removed)], pa.binary()).cast(pa.string()),
            "repeats": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
        })

    return work


def remove_repeats(docs: DataFrame | Chunks, window: int = WINDOW, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Remove each word covered by a window of `window` words whose sequence also starts earlier in the corpus.

    1. Reference blocks of window/2 words lie back to back in every document; every rolling window of
       that length probes them. A repeated window holds one whole block of its earlier occurrence.
    2. Hits are extended: all windows of `window` words around a hit are compared across the corpus
       by 64-bit hash; overlapping repeated windows make up the maximal repeats.
    3. A window counts as first at the smallest (doc_id, start); the words of all others go.
    No pair of documents is ever formed, so a passage that many share costs one key for each chunk.

    Returns chunk, row (the document's address), doc_id, n_words, n_removed, kept_sha256, and kept_text
    where words were removed (null: the text stays as it is), and repeats: the maximal runs of words that
    windows with an earlier start cover, as word numbers [start, end). Null and empty texts have no words. A null
    doc_id sorts before all others; rows that repeat a doc_id count as later occurrences in the order of
    their address. An empty table gives an empty result; other columns are not read.
    """
    block = window // 2
    chunks = Chunks(docs) if isinstance(docs, DataFrame) else docs
    pieces, bits = chunks.rows, power_of_two(chunks.size / bucket_bytes).bit_length() - 1
    probes = pieces.mapInArrow(_probe(block, bits), "chunk long, first_row long, n_rows int, bucket int, keys binary, flags binary")
    hits = materialize(probes.groupBy("bucket").applyInArrow(_hits, "chunk long, first_row long, n_rows int, bucket int, mask binary, n int"), "hits")
    extended = materialize(pieces.groupBy("chunk").cogroup(hits.groupBy("chunk")).applyInArrow(_extend(window, block, bits), _EXTENDED), "extended")
    sent = extended.where("kind = 'window'").select("chunk", "first_row", "bucket", "keys", "ids")
    judged = materialize(sent.groupBy("bucket").applyInArrow(_judge, "chunk long, first_row long, bucket int, mask binary, n int"), "judged")
    documents = extended.where("kind = 'document'")
    touched = documents.where("text is not null").select("chunk", "first_row", "row", "doc_id", "n_words", "text", "candidates")
    schema = "chunk long, row long, doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string, repeats " + _SPANS
    removed = touched.groupBy("chunk", "first_row").cogroup(judged.groupBy("chunk", "first_row")).applyInArrow(_remove(window), schema)
    whole = documents.where("text is null").select("chunk", "row", "doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.lit(None).cast("string").alias("kept_text"), F.array().cast(_SPANS).alias("repeats"))
    return whole.unionByName(removed)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


OP5_SQL = r"""
with w as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents
), starts as (
  select doc_id, unnest(range(1, greatest(len(words) - 18, 1))) as s from w where len(words) >= 20
), win as (
  select starts.doc_id, s, md5(array_to_string(words[s:s + 19], ' ')) as h from starts join w using (doc_id)
), late as (
  select doc_id, s from (select doc_id, s, row_number() over (partition by h order by doc_id, s) as k from win) where k > 1
), gone as (
  select distinct doc_id, unnest(range(s, s + 20)) as p from late
), kept as (
  select w.doc_id, p, words[p] as word from (select doc_id, words, unnest(range(1, len(words) + 1)) as p from w) w anti join gone using (doc_id, p)
), text as (
  select doc_id, string_agg(word, ' ' order by p) as t, count(*) as n from kept group by doc_id
)
select w.doc_id, len(words)::bigint as n_words, (len(words) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(t, '')) as kept_sha256
from w left join text using (doc_id)
"""
