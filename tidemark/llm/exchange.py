"""Packed key exchange: what tasks ask about many keys, answered where all askers of a key meet.

A task that holds a chunk of documents has millions of keys (window or n-gram hashes). It sends each
distinct key once, packed with its neighbours of the same bucket into one binary value, so a shuffle
moves few rows of plain numbers. Buckets are the keys' top bits, so sorted keys fall into them in order.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: Distinct keys meant for one bucket.
BUCKET_KEYS = 2_000_000


def by_bucket(sorted_keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of each non-empty bucket of sorted 64-bit keys; 2**bits buckets."""
    if not len(sorted_keys):
        return []
    buckets = (sorted_keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(sorted_keys), np.int64)
    cuts = [0, *(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1).tolist(), len(buckets)]
    return [(int(buckets[a]), a, b) for a, b in zip(cuts, cuts[1:])]


def join_binary(column: pa.ChunkedArray, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All values of a binary column as one array of dtype, and where each row's part starts (one more at the end)."""
    values = [np.frombuffer(v or b"", dtype) for v in column.to_pylist()]
    starts = np.concatenate(([0], np.cumsum([len(v) for v in values]))).astype(np.int64)
    return (np.concatenate(values) if values else np.zeros(0, dtype)), starts


def groups_of(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts values (stably), and the number of the group of equals at each sorted place."""
    order = np.argsort(values, kind="stable")
    v = values[order]
    new = np.ones(len(v), bool)
    new[1:] = v[1:] != v[:-1]
    return order, np.cumsum(new) - 1


def unpack(bits: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=n).astype(bool)
