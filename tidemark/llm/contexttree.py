"""Context-tree weighting over bytes: a language model counted, weighted and applied by packed exchanges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Chunks, materialize, power_of_two, read_table
from tidemark.llm.exchange import by_bucket, join_binary
from tidemark.llm.textarrays import column, crc32_text, hash_words, runs

#: Bytes of context at the deepest nodes.
DEPTH = 5
#: One document in FOLDS (by crc32 of its id) is held out.
FOLDS = 10
CHUNK = 4096
BUCKET_BYTES = 1 << 24
#: Chunks that meet in one task to ask about the n-grams of one bucket.
ASKERS = 256
#: Bytes turned into n-grams at a time.
PIECE = 1 << 20
_U = np.uint64
_LOG2 = float(np.log10(2))
#: A bijection of the last two context bytes that spreads them over buckets; a subtree below two bytes lies in one bucket.
_PAIR = ((np.arange(65536, dtype=np.uint64) * _U(40503)) & _U(0xFFFF)) << _U(48)
_UNPAIR = np.argsort(_PAIR >> _U(48)).astype(np.int64)


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[bytes, list[int], list[int]]]:
    """Streams of at most about PIECE bytes: for each segment DEPTH bytes of context and its symbols.

    A text is preceded by zero bytes and followed by one (the end symbol). Yields the stream, the
    segments' lengths, and their texts' numbers.
    """
    raw, pad = data.tobytes().lower(), b"\0" * DEPTH  # lower() on bytes changes A-Z only
    parts, lengths, texts, held = [], [], [], 0
    for i in range(len(offsets) - 1):
        a, end = int(offsets[i]), int(offsets[i + 1])
        at = a
        while True:
            to = min(end, at + PIECE)
            before = pad if at == a else (pad + raw[max(a, at - DEPTH) : at])[-DEPTH:]
            part = before + raw[at:to] + (b"\0" if to == end else b"")
            parts.append(part)
            lengths.append(len(part))
            texts.append(i)
            held += len(part)
            if held >= PIECE:
                yield b"".join(parts), lengths, texts
                parts, lengths, texts, held = [], [], [], 0
            at = to
            if at == end:
                break
    if parts:
        yield b"".join(parts), lengths, texts


def grams(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys of all symbols with their context, where each segment starts among them, the segments' texts)."""
    for stream, lengths, texts in _pieces(data, offsets):
        s = np.frombuffer(stream, np.uint8).astype(np.uint64)
        n = len(s) - DEPTH
        keys = _PAIR[((s[DEPTH - 1 : DEPTH - 1 + n] << _U(8)) | s[DEPTH - 2 : DEPTH - 2 + n]).astype(np.int64)]
        for k in range(3, DEPTH + 1):
            keys |= s[DEPTH - k : DEPTH - k + n] << _U(64 - 8 * k)
        keys |= s[DEPTH:] << _U(56 - 8 * DEPTH)
        size = np.array(lengths)
        starts = np.cumsum(size) - size
        valid = np.ones(len(s), bool)
        valid[(starts[:, None] + np.arange(DEPTH)).ravel()] = False
        yield keys[valid[DEPTH:]], np.cumsum(size - DEPTH) - (size - DEPTH), np.array(texts)


def _merge(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and their summed counts."""
    if not keys:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k = k[order]
    new = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
    return k[new], np.add.reduceat(c[order], new)


def _ask(bits: int):
    """Each run's distinct words and n-grams with their counts in training documents (0: in held-out ones only)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches):
            data, offsets = column(run.column("text"))
            train = crc32_text(run.column("doc_id").to_pylist()) % FOLDS != 0
            hashes, counts = hash_words(data, offsets, lower=True)
            learnt = np.repeat(train, counts)
            (known, times), (other, zero) = np.unique(hashes[learnt], return_counts=True), np.unique(hashes[~learnt], return_counts=True)
            words = _merge([known, other], [times, 0 * zero])
            del hashes, learnt
            ks, cs = [], []
            for keys, starts, texts in grams(data, offsets):
                of = np.repeat(train[texts], np.diff(np.append(starts, len(keys))))
                for part, learn in ((keys[of], 1), (keys[~of], 0)):
                    u, c = np.unique(part, return_counts=True)
                    ks.append(u)
                    cs.append(c * learn)
                if len(ks) >= 16:
                    merged = _merge(ks, cs)
                    ks, cs = [merged[0]], [merged[1]]
            rows = run.column("row").to_numpy()
            at = (run.column("chunk")[0].as_py(), int(rows[0]), len(rows))
            for kind, (keys, count), width in ((0, words, bits), (1, _merge(ks, cs), min(bits, 16))):
                found = by_bucket(keys, width) or [(0, 0, 0)]
                yield pa.RecordBatch.from_pydict({
                    "kind": pa.array([kind] * len(found), pa.int32()), "bucket": pa.array([b for b, _, _ in found], pa.int32()), "chunk": pa.array([at[0]] * len(found), pa.int64()),
                    "first_row": pa.array([at[1]] * len(found), pa.int64()), "n_rows": pa.array([at[2]] * len(found), pa.int32()),
                    "keys": [keys[a:b].astype("<u8").tobytes() for _, a, b in found], "counts": [count[a:b].astype("<u4").tobytes() for _, a, b in found],
                })

    return work


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln Gamma for x > 0 by Stirling's series, after moving small x up by 8."""
    low = x < 8
    y = np.where(low, x + 8, x)
    inv = 1 / (y * y)
    out = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - inv * (1 / 360 - inv * (1 / 1260 - inv / 1680))) / y
    shift = np.ones(int(low.sum()))
    for k in range(8):
        shift = shift * (x[low] + k)
    out[low] -= np.log(shift)
    return out


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov estimate of any sequence with so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1.0) - 1.1447298858494002


def _nodes(context: np.ndarray, byte: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Binary nodes (context << 8 | the bits so far with a leading 1) and their zeros and ones, from byte counts."""
    keys, zeros, ones = [], [], []
    for j in range(8):
        keys.append((context << 8) | (1 << j) | (byte >> (8 - j)))
        bit = (byte >> (7 - j)) & 1
        ones.append(count * bit)
        zeros.append(count * (1 - bit))
    k = np.concatenate(keys)
    unique, place = np.unique(k, return_inverse=True)
    return unique, np.bincount(place, np.concatenate(zeros), len(unique)), np.bincount(place, np.concatenate(ones), len(unique))


class Level:
    """The nodes of one depth: stop weight and chance of a one, by node key."""

    def __init__(self, keys: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray | None):
        self.keys = keys
        kt = log_kt(zeros, ones)
        self.chance = (ones + 0.5) / (zeros + ones + 1)
        if below is None:
            self.stop, self.log = np.ones(len(keys)), kt
        else:  # half for this estimate, half for the product of the children's
            self.stop = 1 / (1 + np.exp(np.clip(below - kt, -700, 700)))
            self.log = np.logaddexp(kt, below) - np.log(2)


def _subtrees(keys: np.ndarray, counts: np.ndarray) -> tuple[list[Level], list[np.ndarray]]:
    """Levels DEPTH to 2 from distinct n-grams sorted by key, and each row's context number at each of them."""
    byte = ((keys >> _U(56 - 8 * DEPTH)) & _U(255)).astype(np.int64)
    seen = counts > 0
    levels, numbers, lower = [], [], None
    for d in range(DEPTH, 1, -1):
        context = keys >> _U(64 - 8 * d)
        number = np.cumsum(np.concatenate(([0], (context[1:] != context[:-1]).astype(np.int64)))) if len(keys) else np.zeros(0, np.int64)
        nodes, zeros, ones = _nodes(number[seen], byte[seen], counts[seen])
        below = None
        if lower is not None:  # the product over the deeper contexts that end in this one
            level, child_of = lower
            parent = number[child_of][level.keys >> 8] << 8 | (level.keys & 255)
            below = np.bincount(np.searchsorted(nodes, parent), level.log, len(nodes))
        levels.append(Level(nodes, zeros, ones, below))
        numbers.append(number)
        first = np.flatnonzero(np.concatenate(([True], number[1:] != number[:-1]))) if len(keys) else np.zeros(0, np.int64)
        lower = (levels[-1], first)
    return levels, numbers


_GATHERED = "what string, kind int, bucket int, part int, chunk long, first_row long, n_rows int, keys binary, vals binary"
_GATHERED_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
_TOTALS = "what string, kind int, bucket int, keys binary, vals binary, total long, distinct_n long"
_TOTALS_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]


def _table(rows: list[tuple], types: list, schema: str) -> pa.Table:
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], [x.split()[0] for x in schema.split(", ")])


def _gather(table: pa.Table) -> pa.Table:
    """Where ASKERS of a bucket meet: their distinct keys with summed counts, and each asker's places among them."""
    at = tuple(table.column(c)[0].as_py() for c in ("kind", "bucket", "part"))
    keys, starts = join_binary(table.column("keys"), "<u8")
    counts, _ = join_binary(table.column("counts"), "<u4")
    unique, place = np.unique(keys, return_inverse=True)
    total = np.bincount(place, counts, len(unique)).astype("<i8")
    asker = zip(table.column("chunk").to_pylist(), table.column("first_row").to_pylist(), table.column("n_rows").to_pylist())
    out = [("place", *at, *x, None, place[a:b].astype("<u4").tobytes()) for x, a, b in zip(asker, starts, starts[1:])]
    out.append(("part", *at, None, None, None, unique.tobytes(), total.tobytes()))
    return _table(out, _GATHERED_TYPES, _GATHERED)


def _total(table: pa.Table) -> pa.Table:
    """Where all parts of a bucket meet: the corpus's counts, and what the two top levels need handed up."""
    kind, bucket = table.column("kind")[0].as_py(), table.column("bucket")[0].as_py()
    keys, _ = join_binary(table.column("keys"), "<u8")
    counts, _ = join_binary(table.column("vals"), "<i8")
    unique, total = _merge([keys], [counts]) if len(keys) else (keys, counts)
    out = [("total", kind, bucket, unique.tobytes(), total.astype("<i8").tobytes(), int(total.sum()), int((total > 0).sum()))]
    if kind == 1 and len(unique):
        levels, _ = _subtrees(unique, total)
        pairs = np.unique(unique >> _U(48))
        last = _UNPAIR[pairs.astype(np.int64)] >> 8  # the last byte of each two-byte context
        level = levels[-1]
        node = last[level.keys >> 8] << 8 | (level.keys & 255)
        tops, where = np.unique(node, return_inverse=True)
        logs = np.bincount(where, level.log, len(tops))
        byte = ((unique >> _U(56 - 8 * DEPTH)) & _U(255)).astype(np.int64)
        one, zeros, ones = _nodes(_UNPAIR[(unique >> _U(48)).astype(np.int64)][total > 0] >> 8, byte[total > 0], total[total > 0])
        out.append(("top", kind, bucket, one.astype("<i8").tobytes(), np.concatenate((zeros, ones, logs[np.searchsorted(tops, one)])).astype("<f8").tobytes(), None, None))
    return _table(out, _TOTALS_TYPES, _TOTALS)


def _top_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for keys, vals in zip(batch.column("keys").to_pylist(), batch.column("vals").to_pylist()):
            v = np.frombuffer(vals, "<f8").reshape(3, -1)
            yield pa.RecordBatch.from_pydict({"node": np.frombuffer(keys, "<i8"), "zeros": v[0], "ones": v[1], "below": v[2]})


def _top_levels(totals: DataFrame) -> list[Level]:
    """Levels 1 and 0. They have 256 * 255 and 255 nodes at most, whatever the corpus, so they fit the driver."""
    rows = totals.where("what = 'top'").select("keys", "vals").mapInArrow(_top_rows, "node long, zeros double, ones double, below double")
    one = rows.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).orderBy("node").toPandas()
    first = Level(one["node"].to_numpy(np.int64), one["zeros"].to_numpy(float), one["ones"].to_numpy(float), one["below"].to_numpy(float))
    prefixes, place = np.unique(first.keys & 255, return_inverse=True)
    root = Level(prefixes, *(np.bincount(place, x, len(prefixes)) for x in (one["zeros"], one["ones"], first.log)))
    return [root, first]


def _logs(tops: list[Level], keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """log10 of each n-gram's chance, mixed over the depths from the root down."""
    levels, numbers = _subtrees(keys, counts)
    byte = ((keys >> _U(56 - 8 * DEPTH)) & _U(255)).astype(np.int64)
    path = [(tops[0], np.zeros(len(keys), np.int64)), (tops[1], _UNPAIR[(keys >> _U(48)).astype(np.int64)] >> 8), *zip(levels[::-1], numbers[::-1])]
    score = np.zeros(len(keys))
    for j in range(8):
        prefix = (1 << j) | (byte >> (8 - j))
        one, left = np.zeros(len(keys)), np.ones(len(keys))
        for level, number in path:
            if not len(level.keys):
                continue
            node = number << 8 | prefix
            k = np.minimum(np.searchsorted(level.keys, node), len(level.keys) - 1)
            known = level.keys[k] == node
            stop = np.where(known, level.stop[k], 0)
            one += left * stop * level.chance[k]
            one += np.where(known, 0, left * 0.5)  # nothing was learnt from here on
            left = np.where(known, left * (1 - stop), 0)
        one += left * 0.5
        score += np.log10(np.where((byte >> (7 - j)) & 1, one, 1 - one))
    return score


def _value(tops: list[Level]):
    """What is answered for each key of a bucket: a word's count, an n-gram's log10 chance (both as doubles)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind, bucket, keys, vals in zip(*(batch.column(c).to_pylist() for c in ("kind", "bucket", "keys", "vals"))):
                counts = np.frombuffer(vals, "<i8")
                answer = counts.astype("<f8") if kind == 0 else _logs(tops, np.frombuffer(keys, "<u8"), counts).astype("<f8")
                yield pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "known": [keys], "answers": [answer.tobytes()]})

    return work


def _own(parts: pa.Table, valued: pa.Table) -> pa.Table:
    """Each part's answers, in the order of its keys: a part gets what it asked for, not the whole bucket."""
    columns = ["kind", "bucket", "part"]
    if not len(parts) or not len(valued):
        return parts.slice(0, 0).select(columns).append_column("given", pa.array([], pa.binary()))
    known, answers = (np.frombuffer(valued.column(c)[0].as_py(), t) for c, t in (("known", "<u8"), ("answers", "<f8")))
    given = [answers[np.searchsorted(known, np.frombuffer(k, "<u8"))].tobytes() for k in parts.column("keys").to_pylist()]
    return parts.select(columns).append_column("given", pa.array(given, pa.binary()))


def _answer(places: pa.Table, values: pa.Table) -> pa.Table:
    """Each asker's answers, in the order of its keys."""
    given = np.frombuffer(values.column("given")[0].as_py(), "<f8")
    found = [given[np.frombuffer(v, "<u4")].tobytes() for v in places.column("vals").to_pylist()]
    return places.select(["chunk", "first_row", "n_rows", "kind", "bucket"]).append_column("vals", pa.array(found, pa.binary()))


class Lookup:
    """Place of keys in a sorted array: two direct-mapped tables, and binary search for what collides in both."""

    def __init__(self, keys: np.ndarray):
        self.keys, self.bits = keys, max(8, int(len(keys)).bit_length() + 2)
        self.tables = []
        for mult in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            t = np.zeros(1 << self.bits, np.int32)
            t[self._slot(keys, mult)] = np.arange(len(keys), dtype=np.int32)
            self.tables.append((mult, t))

    def _slot(self, keys: np.ndarray, mult: int) -> np.ndarray:
        return ((keys * _U(mult)) >> _U(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        (m, t), (m2, t2) = self.tables
        out = t[self._slot(keys, m)]
        bad = np.flatnonzero(self.keys[out] != keys)
        out[bad] = t2[self._slot(keys[bad], m2)]
        bad = bad[self.keys[out[bad]] != keys[bad]]
        out[bad] = np.searchsorted(self.keys, keys[bad])
        return out


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"


def _score(train_tokens: int, train_docs: int, vocabulary: int):
    below = np.log10(train_tokens + 0.1 * (vocabulary + 1)) if train_tokens else 0.0

    def run_of(part: pa.Table, words: pa.Table, logs: pa.Table) -> list[tuple]:
        data, offsets = column(part.column("text"))
        hashes, counts = hash_words(data, offsets, lower=True)
        answer = np.frombuffer(b"".join(words.column("vals").to_pylist()), "<f8")
        unique, place = np.unique(hashes, return_inverse=True)
        seen = answer[place]
        del unique, place, hashes
        ends = np.cumsum(counts)
        first = ends - counts

        def by_text(x: np.ndarray) -> np.ndarray:
            s = np.concatenate(([0.0], np.cumsum(x)))
            return s[ends] - s[first]

        n_known = by_text(seen > 0).astype(np.int64) + (train_docs > 0)
        base = by_text(np.log10(seen + 0.1) - below) + np.log10(train_docs + 0.1) - below
        ks = []
        for keys, _, _ in grams(data, offsets):
            ks.append(np.unique(keys))
            if len(ks) >= 16:
                ks = [np.unique(np.concatenate(ks))]
        find = Lookup(np.unique(np.concatenate(ks)))
        log = np.frombuffer(b"".join(logs.column("vals").to_pylist()), "<f8")
        score = np.zeros(len(counts))
        for keys, starts, texts in grams(data, offsets):
            np.add.at(score, texts, np.add.reduceat(log[find(keys)], starts))
        ids = part.column("doc_id").to_pylist()
        held = crc32_text(ids) % FOLDS == 0
        return [(i, bool(h), int(n) + 1, int(k), train_tokens, float(b), float(s), int(z), float(-s / _LOG2 / max(1, z))) for i, h, n, k, b, s, z in zip(ids, held, counts, n_known, base, score, np.diff(offsets))]

    def work(docs: pa.Table, answers: pa.Table) -> pa.Table:
        docs, out = docs.sort_by("row"), []
        answers = answers.sort_by([("first_row", "ascending"), ("kind", "ascending"), ("bucket", "ascending")])
        rows, firsts, kinds = docs.column("row").to_numpy(), answers.column("first_row").to_numpy(), answers.column("kind").to_numpy()
        for f in np.unique(firsts):
            words, logs = (answers.filter(pa.array((firsts == f) & (kinds == k))) for k in (0, 1))
            out += run_of(docs.slice(int(np.searchsorted(rows, f)), words.column("n_rows")[0].as_py()), words, logs)
        types = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64(), pa.float64()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], [x.split()[0] for x in _SCORED.split(", ")])

    return work


def score_documents(docs: DataFrame, chunk_rows: int = CHUNK, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """log10 probability of every whole text under a context-tree-weighted byte model of the training texts.

    Learns from documents whose crc32(doc_id as text) mod 10 is not 0. A symbol is a byte of the text with
    A-Z in lower case, or the end; it is coded as 8 bits, each by the nodes of the contexts of 0 to DEPTH
    bytes before it. A node mixes its Krichevsky-Trofimov estimate with its children's, half and half, so
    the bit's chance is an average over all depths with the weights the training texts give them.

    bits_per_byte is the code length of the text and its end, -log2 of that probability, for each byte of the
    text (of an empty text: for its end alone).

    Also gives the base: the sum over tokens of log10((c + 0.1) / (N + 0.1 * (V + 1))), tokens being
    lower-cased words and one end. Words are counted by 64-bit hash.

    A null text is the empty text: one end token, one end symbol. A null doc_id has the checksum of the
    empty text, 0, and is held out. With no training document c, N and V are 0 and log10 of N + 0.1 * (V + 1) is
    taken as 0. Repeated rows count as often as they occur; an empty table gives an empty result.
    """
    chunks = Chunks(docs, chunk_rows)
    pieces = chunks.rows
    bits = power_of_two(chunks.size / bucket_bytes).bit_length() - 1
    asked = pieces.mapInArrow(_ask(bits), "kind int, bucket int, chunk long, first_row long, n_rows int, keys binary, counts binary")
    asked = asked.withColumn("part", F.pmod(F.xxhash64("chunk"), F.lit(-(-chunks.count // ASKERS) or 1)).cast("int"))
    gathered = materialize(asked.groupBy("kind", "bucket", "part").applyInArrow(_gather, _GATHERED), "gathered")
    parts = gathered.where("what = 'part'").select("kind", "bucket", "part", "keys", "vals")
    totals = materialize(parts.groupBy("kind", "bucket").applyInArrow(_total, _TOTALS), "totals")
    words = totals.where("kind = 0 and what = 'total'").agg(F.sum("total"), F.sum("distinct_n")).first()
    train_docs = docs.where(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % FOLDS != 0).count()
    train_tokens, vocabulary = (words[0] or 0) + train_docs, (words[1] or 0) + (train_docs > 0)
    valued = totals.where("what = 'total'").select("kind", "bucket", "keys", "vals").mapInArrow(_value(_top_levels(totals)), "kind int, bucket int, known binary, answers binary")
    values = parts.drop("vals").groupBy("kind", "bucket").cogroup(valued.groupBy("kind", "bucket")).applyInArrow(_own, "kind int, bucket int, part int, given binary")
    places = gathered.where("what = 'place'").select(*[F.col(c).alias(c) for c in ("kind", "bucket", "part", "chunk", "first_row", "n_rows", "vals")])
    key = ["kind", "bucket", "part"]
    answers = places.groupBy(*key).cogroup(values.groupBy(*key)).applyInArrow(_answer, "chunk long, first_row long, n_rows int, kind int, bucket int, vals binary")
    return pieces.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(train_tokens, train_docs, vocabulary), _SCORED)


def op4_context_tree_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(read_table(spark, sf_dir, "documents"))
