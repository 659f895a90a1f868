"""SentencePiece encoding and decoding by max-plus Viterbi, with a parallel scan over giant documents.

The piece file serves as a unigram inventory: an encoding is the segmentation with the highest sum of
piece scores; of several, the one whose pieces, read from the end, are the longest. A text is a path over its
character positions; a chunk of it maps the state at its left boundary (how far the piece that crosses it
reaches into the chunk) to the state at its right one, a small max-plus matrix with the order of tied
paths beside it. Matrices combine associatively, which fixes all boundary states of a document; each
chunk is then traced back on its own. Scores are multiples of 2**-20, so sums are exact, and the ids don't depend on where a text is cut.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Chunks, materialize, read_table
from tidemark.llm.tokens import default_path

#: Bytes from which a document is cut into chunks, a chunk's characters, and the chunks whose matrices are combined in one task.
GIANT, CHUNK, GROUP = 1 << 15, 1 << 13, 512
#: Chunks of one task.
TASK_CHUNKS = 256
#: Runs remembered by a worker, and the longest one that is.
MEMO, LONGEST = 400_000, 32
SPACE = "▁"
#: Stands for U+2581 in a text (half a surrogate pair: no text holds one); it is spelled in bytes, so that decoding gives it back.
ESCAPED = "\ud800"
_RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_NORMAL, _UNKNOWN, _USER, _BYTE = 1, 2, 4, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            n = 8 if kind == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n


def read_pieces(path: str) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id, from a SentencePiece model file."""
    with open(path, "rb") as f:
        model = f.read()
    found = []
    for number, value in _fields(model):
        if number == 1:
            piece = dict(_fields(value))
            found.append((piece[1].decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, _NORMAL)))
    return found


def zipf_scores(pieces: list[tuple[str, float, int]]) -> list[float]:
    """Natural log of 1 / ((rank + 1) * H) to 20 binary places: a unigram distribution from the pieces' order of merit.

    A merge-ranked file's scores are only an order; summed as they are they would favour short pieces.
    """
    normal = [i for i, p in enumerate(pieces) if p[2] == _NORMAL]
    h = float(np.sum(1.0 / np.arange(1, len(normal) + 1)))
    out = [0.0] * len(pieces)
    for rank, i in enumerate(sorted(normal, key=lambda i: -pieces[i][1])):
        out[i] = float(np.round(-np.log((rank + 1) * h) * 2**20) / 2**20)
    return out


class Inventory:
    """Pieces, their scores, and Viterbi over them."""

    def __init__(self, path: str):
        pieces = read_pieces(path)
        scores = zipf_scores(pieces)
        best = {p: (s, i) for i, ((p, _, kind), s) in enumerate(zip(pieces, scores)) if kind in (_NORMAL, _USER)}
        self.longest = max(map(len, best))
        self.unknown = min(s for s, _ in best.values()) - 10
        self.bytes = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == _BYTE}
        self.unk_id = next(i for i, p in enumerate(pieces) if p[2] == _UNKNOWN)
        value = lambda p, kind: bytes([int(p[3:5], 16)]) if kind == _BYTE else p.replace(SPACE, " ").encode() if kind in (_NORMAL, _USER) else b""
        self.text = [value(p, kind) for p, _, kind in pieces]
        #: the pieces as a tree by characters: (children, score, id or -1)
        self.tree: dict = {}
        for p in sorted(best):  # a prefix comes before what it begins
            node = self.tree
            for c in p[:-1]:
                node = node.setdefault(c, ({}, 0.0, -1))[0]
            node[p[-1]] = ({}, *best[p])
        #: no piece crosses the start of a run of spaces, so a text may be cut there
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", p) for p in best)
        self.memo: dict[str, bytes] = {}

    def edges(self, text: str, at: int) -> list[tuple[int, float]]:
        """(where it ends, score) of the pieces that start at a place, shortest first; an unknown character is one too."""
        out, node, j = [], self.tree, at
        while j < len(text) and (found := node.get(text[j])):
            node, score, k = found
            j += 1
            if k >= 0:
                out.append((j, score))
        if not out or out[0][0] != at + 1:
            out.insert(0, (at + 1, self.unknown))
        return out

    def spell(self, c: str) -> list[int]:
        """The ids of an unknown character: its bytes."""
        raw = (SPACE if c == ESCAPED else c).encode("utf-8", "replace")
        return [self.bytes[b] for b in raw] if self.bytes else [self.unk_id]

    def solve(self, text: str, stop: int | None = None) -> array:
        """Ids of the best path of a text whose pieces all start before stop."""
        n, tree, unknown = len(text), self.tree, self.unknown
        best, begins, which = [-1e300] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
        best[0] = 0.0
        for i in range(n if stop is None else stop):
            b, node, j = best[i], tree, i
            while j < n and (found := node.get(text[j])):
                node, score, k = found
                j += 1
                if k >= 0 and b + score > best[j]:  # of equal ones the first found stays, which is the longest
                    best[j], begins[j], which[j] = b + score, i, k
            first = tree.get(text[i])
            if (not first or first[2] < 0) and b + unknown > best[i + 1]:
                best[i + 1], begins[i + 1], which[i + 1] = b + unknown, i, -1
        out, j = [], n
        while j:
            i = begins[j]
            out += self.spell(text[i])[::-1] if which[j] < 0 else [which[j]]
            j = i
        return array("I", out[::-1])

    def run(self, text: str) -> bytes:
        """Packed ids of a text that is encoded on its own."""
        ids = self.memo.get(text)
        if ids is None:
            ids = self.solve(text).tobytes()
            if len(text) <= LONGEST:
                if len(self.memo) >= MEMO:
                    self.memo.clear()
                self.memo[text] = ids
        return ids

    def encode(self, text: str) -> array:
        """Ids of a whole normalized text."""
        runs = _RUN.findall(text) if self.cuts else [text]
        ids = array("I")
        ids.frombytes(b"".join(map(self.run, runs)))
        return ids

    def decode(self, ids) -> bytes:
        """The text of ids, with the space in front that normalizing adds."""
        return b"".join(map(self.text.__getitem__, ids))

    def _cut(self, text: str, n: int) -> tuple[int, int] | None:
        """The first and the last place of the chunk that no piece crosses, if there is one."""
        if not self.cuts:
            return None
        last = text.rfind(SPACE, 0, n + 1)
        while last > 0 and text[last - 1] == SPACE:
            last -= 1
        if last <= 0:
            return None
        return next(m.start() + 1 for m in re.finditer(f"[^{SPACE}](?={SPACE})", text)), last

    def _paths(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """[a, b]: score of the best path from place a to place n + b, by pieces that start before n, and the rank of
        these paths among those of the same b: from the end, the one with longer pieces is first.

        Goes from the left with a score for each entry. Once `longest` places in a row agree on the entries'
        differences, so do all places after them: the paths have met, and one score a place suffices.
        """
        w, size = self.longest, min(len(text), n + self.longest - 1)
        best, begins = np.full((size + 1, w), -np.inf), np.full((size + 1, w), -1, np.int64)
        at = np.arange(min(w, size + 1))
        best[at, at] = 0.0
        met, live = n, np.zeros(w, bool)
        for i in range(n):
            if i >= 2 * w and i % 8 == 0:
                part = best[i - w + 1 : i + 1]
                live = np.isfinite(part).all(0)
                if live.any() and (np.isfinite(part).any(0) == live).all():
                    apart = part[:, live] - part[:, live][:, :1]
                    if (apart == apart[0]).all():
                        met = i
                        break
            for to, score in self.edges(text, i):
                if to <= size:
                    sums = best[i] + score
                    better = sums > best[to]
                    best[to][better], begins[to][better] = sums[better], i
        one, land = [-np.inf] * (size + 1), list(range(size + 1))  # where a path that ends here leaves the part with all entries
        col = int(live.argmax())
        if met < n:
            one[: met + 1] = best[: met + 1, col].tolist()
            for j in range(met + 1, size + 1):  # pieces that start before met and reach beyond it
                one[j], land[j] = best[j, col], int(begins[j, col])
            for i in range(met, n):
                for j, score in self.edges(text, i):
                    if j <= size and one[i] + score > one[j]:
                        one[j], land[j] = one[i] + score, i if i <= met else land[i]
        scores, ranks, known = np.full((w, w), -np.inf), np.full((w, w), w, np.int64), {}
        for b in range(min(w, size - n + 1)):
            j, z = n + b, land[n + b]
            scores[:, b] = best[j] if met == n else one[j] + (best[met] - best[met, col]) if np.isfinite(one[j]) else -np.inf
            if z not in known:
                paths = []
                for a in np.flatnonzero(np.isfinite(best[z])):
                    at, path = z, []
                    while at != a:
                        at = int(begins[at, a])
                        path.append(at)
                    paths.append((path, int(a)))
                known[z] = np.full(w, w, np.int64)
                for k, (_, a) in enumerate(sorted(paths)):  # earlier starts first; an entry comes before what goes on from it
                    known[z][a] = k
            ranks[:, b] = known[z]
        for a in range(n, w):  # a short chunk that one piece covers whole
            scores[a, a - n] = 0.0
        return scores, ranks

    def transfer(self, text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The chunk's max-plus matrix and the ranks of its tied entries. text: its n characters and up to longest - 1 of the next.

        [a, b]: the best score from place a of the chunk to place n + b, by pieces that start in the chunk, up
        to one constant: what lies between the first and the last place that no piece crosses is on every path.
        """
        w, cut = self.longest, self._cut(text, n)
        if not cut:
            return self._paths(text, n)
        first, last = cut
        heads, ranks = self._paths(text[:first], first)
        tail = [0.0] + [-np.inf] * (n + w - 1 - last)
        for i in range(last, n):
            for j, s in self.edges(text, i):
                tail[j - last] = max(tail[j - last], tail[i - last] + s)
        return heads[:, :1] + np.array(tail[n - last : n - last + w])[None, :], np.tile(ranks[:, :1], (1, w))

    def trace(self, text: str, n: int, a: int, b: int) -> array:
        """Ids of the pieces that start in the chunk, between its boundary states."""
        if a >= n:
            return array("I")
        cut = self._cut(text, n)
        if not cut:
            return self.solve(text[a : n + b], n - a)
        first, last = cut
        return self.solve(text[a:first]) + self.encode(text[first:last]) + self.solve(text[last : n + b], n - last)


@lru_cache(maxsize=2)
def inventory(path: str) -> Inventory:
    """One for each worker and file."""
    return Inventory(path)


def max_plus(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The product of two transfer matrices with their ranks; associative. Ties go to the path that is first on the right."""
    sums = x[0][:, :, None] + y[0][None, :, :]
    best = sums.max(1)
    via = np.where((sums == best[:, None, :]) & np.isfinite(sums), y[1][None, :, :], len(best) + 1).argmin(1)
    rows, columns = np.arange(len(best))[:, None], np.arange(len(best))[None, :]
    order = np.where(np.isfinite(best), y[1][via, columns] * (len(best) + 2) + x[1][rows, via], np.iinfo(np.int64).max)
    return best, order.argsort(0, kind="stable").argsort(0, kind="stable")


def boundary_states(matrices: list[tuple[np.ndarray, np.ndarray]], enters: int = 0, leaves: int = 0) -> list[int]:
    """The best path's state at every boundary, between the given ones before the first chunk and after the last.

    Products over halves are combined recursively, so any bracketing of the chunks gives the same states.
    """
    products: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}

    def product(i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
        if j - i == 1:
            return matrices[i]
        if (i, j) not in products:
            m = (i + j) // 2
            products[i, j] = max_plus(product(i, m), product(m, j))
        return products[i, j]

    states = [enters] + [0] * (len(matrices) - 1) + [leaves]
    todo = [(0, len(matrices))]
    while todo:
        i, j = todo.pop()
        if j - i > 1:
            m = (i + j) // 2
            left, right = product(i, m), product(m, j)
            sums = left[0][states[i]] + right[0][:, states[j]]
            states[m] = int(np.where((sums == sums.max()) & np.isfinite(sums), right[1][:, states[j]], len(sums) + 1).argmin())
            todo += [(i, m), (m, j)]
    return states


def combined(matrices: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The product of all, by halves."""
    while len(matrices) > 1:
        pairs = [max_plus(a, b) for a, b in zip(matrices[::2], matrices[1::2])]
        matrices = pairs + matrices[len(pairs) * 2 :]
    return matrices[0]


def _dumped(m: tuple[np.ndarray, np.ndarray]) -> bytes:
    return m[0].astype("<f8").tobytes() + m[1].astype("<i8").tobytes()


def _loaded(b: bytes) -> tuple[np.ndarray, np.ndarray]:
    w = int(round((len(b) // 16) ** 0.5))
    return np.frombuffer(b, "<f8", w * w).reshape(w, w), np.frombuffer(b, "<i8", w * w, 8 * w * w).reshape(w, w)


def normalized(text: str) -> str:
    """Spaces become the space sign, and one stands in front."""
    return SPACE + text.replace(SPACE, ESCAPED).replace(" ", SPACE) if text else ""


def encode_documents(docs: DataFrame, model: str | None = None, giant: int = GIANT, chunk: int = CHUNK, group: int = GROUP, decode: bool = False) -> DataFrame:
    """chunk, row (the document's address), doc_id, text as bytes, ids (unsigned 32-bit, packed) and the number of chunks.

    decode adds decoded, the ids' text as bytes, as decode_documents does, in the same tasks.

    Documents of more than `giant` bytes are cut into chunks of `chunk` characters that go to different
    tasks: once for their transfer matrices, once for their ids. `group` matrices are combined in one task,
    and the groups' products in another, so no task holds more than that many or a text's length / (chunk * group).

    A tie goes to the longer piece, from the end, so ids don't depend on giant, chunk and group. U+2581 is
    spelled in bytes. A null or empty text has no ids. Repeated rows each give a row; a null doc_id stays
    null; an empty table gives an empty result. Other columns are not read.
    """
    model = model or default_path("piece_bpe_32k.model")
    rows = Chunks(docs).rows
    body = F.coalesce("text", F.lit(b""))
    names = ["chunk", "row", "doc_id", "text", "ids", "n_chunks", *(["decoded"] if decode else [])]
    more = ", decoded binary" if decode else ""

    def back(inv: Inventory, ids: list[bytes], skip: int) -> list[pa.Array]:
        return [pa.array([inv.decode(memoryview(i).cast("I"))[skip:] for i in ids], pa.binary())] if decode else []

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inv = inventory(model)
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            ids = [inv.encode(normalized((t or b"").decode("utf-8", "replace"))).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names[:4]), pa.array(ids, pa.binary()), pa.array([1] * len(ids), pa.int32()), *back(inv, ids, 1)], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = inventory(model).longest - 1
        for batch in batches:
            for c, r, t in zip(batch.column("chunk").to_pylist(), batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                text = normalized(t.decode("utf-8", "replace"))
                starts = range(0, len(text), chunk)
                for k in range(0, len(starts), 64):
                    some = starts[k : k + 64]
                    yield pa.RecordBatch.from_pydict({
                        "chunk": pa.array([c] * len(some), pa.int64()), "row": pa.array([r] * len(some), pa.int64()), "part": pa.array(range(k, k + len(some)), pa.int32()),
                        "n": pa.array([min(chunk, len(text) - s) for s in some], pa.int32()), "piece": [text[s : s + chunk + over].encode("utf-8", "surrogatepass") for s in some],
                    })

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inv = inventory(model)
        for batch in batches:
            m = [_dumped(inv.transfer(p.decode("utf-8", "surrogatepass"), n)) for p, n in zip(batch.column("piece").to_pylist(), batch.column("n").to_pylist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk", "row", "part")), pa.array(m, pa.binary())], ["chunk", "row", "part", "matrix"])

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("part")
        return pdf[["chunk", "row", "set"]].head(1).assign(matrix=[_dumped(combined([_loaded(m) for m in pdf["matrix"]]))])

    def between_sets(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("set")
        s = boundary_states([_loaded(m) for m in pdf["matrix"]])
        return pdf[["chunk", "row", "set"]].assign(enters=s[:-1], leaves=s[1:])

    def within_set(parts: pd.DataFrame, ends: pd.DataFrame) -> pd.DataFrame:
        parts = parts.sort_values("part")
        s = boundary_states([_loaded(m) for m in parts["matrix"]], int(ends["enters"].iloc[0]), int(ends["leaves"].iloc[0]))
        return parts[["chunk", "row", "part"]].assign(enters=s[:-1], leaves=s[1:])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inv = inventory(model)
        for batch in (b.slice(k, 64) for b in batches for k in range(0, b.num_rows, 64)):
            d = batch.to_pydict()
            ids = [inv.trace(p.decode("utf-8", "surrogatepass"), n, a, b).tobytes() for p, n, a, b in zip(d["piece"], d["n"], d["enters"], d["leaves"])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("chunk", "row", "part")), pa.array(ids, pa.binary()), *back(inv, ids, 0)], ["chunk", "row", "part", "ids", *names[6:]])

    key = ["chunk", "row", "part"]
    small = rows.where(F.octet_length(body) <= giant).mapInArrow(whole, "chunk long, row long, doc_id long, text binary, ids binary, n_chunks int" + more)
    large = rows.where(F.octet_length(body) > giant)
    tasks = max(8, large.agg(F.sum(F.octet_length("text")).alias("b")).select(F.ceil(F.col("b") / (chunk * TASK_CHUNKS))).first()[0] or 0)
    parts = materialize(large.mapInArrow(cut, "chunk long, row long, part int, n int, piece binary"), "parts").repartition(tasks, *key)
    found = parts.mapInArrow(matrices, "chunk long, row long, part int, matrix binary")
    found = materialize(found.withColumn("set", F.floor(F.col("part") / group).cast("int")), "matrices")
    products = found.groupBy("chunk", "row", "set").applyInPandas(product, "chunk long, row long, set int, matrix binary")
    ends = products.groupBy("chunk", "row").applyInPandas(between_sets, "chunk long, row long, set int, enters int, leaves int")
    fixed = found.groupBy("chunk", "row", "set").cogroup(ends.groupBy("chunk", "row", "set")).applyInPandas(within_set, "chunk long, row long, part int, enters int, leaves int")
    ids = parts.join(fixed.repartition(tasks, *key), key).mapInArrow(traced, "chunk long, row long, part int, ids binary" + more)
    whole_of = lambda c: F.expr(f"listagg({c}) within group (order by part)")
    joined = ids.groupBy("chunk", "row").agg(whole_of("ids").alias("ids"), F.count("*").cast("int").alias("n_chunks"), *([F.substring(whole_of("decoded"), 2, 2**31 - 1).alias("decoded")] if decode else []))
    return small.unionByName(large.select("chunk", "row", "doc_id", "text").join(joined, ["chunk", "row"]))


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """Adds decoded (the text of ids as bytes) to rows with packed ids."""
    model = model or default_path("piece_bpe_32k.model")

    @F.pandas_udf("binary")
    def decode(ids: pd.Series) -> pd.Series:
        inv = inventory(model)
        return pd.Series([inv.decode(memoryview(i).cast("I"))[1:] for i in ids])

    return encoded.withColumn("decoded", decode("ids"))


def op6_sentencepiece_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(read_table(spark, sf_dir, "documents"), decode=True)
    body = F.coalesce("text", F.lit(b""))
    return found.select(
        "doc_id", F.octet_length(body).cast("long").alias("n_bytes"), F.floor(F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"),
        "n_chunks", F.sha2("decoded", 256).alias("decoded_sha256"), (F.col("decoded") == body).alias("round_trip"),
    )
