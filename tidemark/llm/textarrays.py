"""Word hashes of many texts at once, in numpy.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. Its 64-bit hash takes in eight bytes at a
time, each time through a bijective finalizer; words of more than LONG bytes get BLAKE2b. The hash of a
window is a tree over its words' hashes, each node finalized. No step is linear in the text, so no family
of texts shares hashes by its form; two given words or windows share one with a chance of about 2**-64.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes hashed at a time; longer texts are cut between words.
PIECE = 1 << 20
#: Words whose windows are hashed at a time.
BLOCK = 1 << 16
_WHITE = np.zeros(256, bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True
def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer: every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: Bytes of the longest word that is hashed eight bytes at a time.
LONG = 64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # masks of the first k bytes
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7))


def _of_words(part: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    size = ends - starts
    eight = np.ndarray(len(part), "<u8", np.concatenate([part, np.zeros(8, np.uint8)]), strides=(1,))  # eight bytes from each byte on
    h = size.astype(np.uint64) * _A
    rest, at = np.arange(len(size)), 0
    while len(rest):
        left = size[rest] - at
        h[rest] = mix((h[rest] ^ (eight[starts[rest] + at] & _FIRST[np.minimum(left, 8)])) * _B + _C)
        rest, at = rest[left > 8], at + 8
        if at == LONG:
            for k in rest.tolist():
                h[k] = int.from_bytes(hashlib.blake2b(part[starts[k] : ends[k]].tobytes(), digest_size=8).digest(), "little")
            break
    return h


def column(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column, without copying one that is whole; nulls are empty."""
    n = len(array)
    if isinstance(array, pa.ChunkedArray):
        array = (array.cast(pa.large_binary()) if array.num_chunks > 1 else array).combine_chunks()  # 2 GB together don't fit in one small column
        array = array.chunk(0) if isinstance(array, pa.ChunkedArray) and array.num_chunks else array
    large = pa.types.is_large_binary(array.type) or pa.types.is_large_string(array.type)
    if n == 0 or array.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(array.buffers()[1], np.int64 if large else np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    data = np.frombuffer(array.buffers()[2], np.uint8) if array.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of the texts data[offsets[i]:offsets[i+1]], and each text's number of words."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    inside = ~_WHITE[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def _pieces(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts of data into pieces of about PIECE bytes, between texts or between words."""
    at, n = 0, len(data)
    while at < n:
        to = min(n, at + PIECE)
        if to < n:
            k = int(np.searchsorted(offsets, to, "right")) - 1
            if offsets[k] > at:
                to = int(offsets[k])
            else:
                size = PIECE
                while True:  # a word may be longer than a piece
                    white = np.flatnonzero(_WHITE[data[max(at, to - 4096) : to]])
                    if len(white):
                        to = max(at, to - 4096) + int(white[-1]) + 1
                        break
                    end = int(offsets[k + 1])
                    if to >= end:
                        to = end
                        break
                    size *= 2
                    to = min(end, at + size)
        yield at, to
        at = to


def hash_words(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and each text's number of words. lower: A-Z count as a-z."""
    hashes = []
    counts = np.zeros(len(offsets) - 1, np.int64)
    for a, b in _pieces(data, offsets):
        i, j = int(np.searchsorted(offsets, a, "right")) - 1, int(np.searchsorted(offsets, b, "left"))
        part = _LOWER[data[a:b]] if lower else data[a:b]
        inner = np.clip(offsets[i : j + 1] - a, 0, b - a)
        starts, ends, n = spans(part, inner)
        counts[i:j] += n
        if len(starts):
            hashes.append(_of_words(part, starts, ends))
    return (np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)), counts


def windows(hashes: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words within one text, and where each starts among all words.

    BLOCK words are looked at together, with those that their windows reach, so little more is held than the result.
    """
    total, ends = len(hashes), np.cumsum(counts)
    rolled, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for a in range(0, total, BLOCK):
        b = min(total, a + BLOCK)
        texts = slice(int(np.searchsorted(ends, a, "right")), int(np.searchsorted(ends, b, "left")) + 1)
        first = ends[texts] - counts[texts]
        here = np.maximum(np.minimum(ends[texts], b) - np.maximum(first, a), 0)
        left = np.repeat(ends[texts], here) - np.arange(a, b)  # words of the text from here on
        at = np.flatnonzero(left >= n)
        if not len(at):
            continue
        tree, whole = hashes[a : min(total, b + n - 1)], None  # tree: hashes of 2**k words from each word on
        for k in range(n.bit_length()):
            if n >> k & 1:
                whole = tree if whole is None else _pair(tree, whole, 1 << k)  # the larger part comes first
            if n >> k + 1:
                tree = _pair(tree, tree, 1 << k)
        rolled.append(mix(whole[at] + np.uint64(n)))
        starts.append(a + at)
    return np.concatenate(rolled), np.concatenate(starts)


def _pair(left: np.ndarray, right: np.ndarray, gap: int) -> np.ndarray:
    """A hash of left[i] and right[i + gap], as far as both exist."""
    size = max(0, min(len(left), len(right) - gap))
    return mix(left[:size] * _A + right[gap : gap + size] + _B)


def release() -> None:
    """Gives memory that is free back to the system: a worker lives on between tasks, several of them in one executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def runs(batches, key: str = "chunk") -> Iterator[pa.Table]:
    """The rows of a mapInArrow iterator as one table for each run of rows that share key."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(held[0].schema.get_field_index(key))[0].as_py() != keys[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
    held = []
    release()


def crc32_text(ids) -> np.ndarray:
    """crc32 of each id written as decimal text; null: of the empty text."""
    import zlib

    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) for i in ids], np.int64)
