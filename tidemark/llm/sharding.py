"""Reproducible shuffle and sharding by a Feistel permutation over global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, read_table, scanned

SHARDS = 16
SEED = 20240229
ROUNDS = 6
#: Rows of one range of the global order.
BIN_ROWS = 100_000
#: Bins, at most; larger tables get larger bins.
BINS = 16_384


def feistel(x: np.ndarray, n: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """A permutation of 0..n-1, one value at a time: cycle walking brings values outside back in.

    The network runs over pairs (a, b) of two mixed-radix halves whose product is n or little more,
    so a walk rarely takes more than two steps.
    """
    if n <= 1:
        return np.zeros(len(x), np.int64)
    p = int(np.ceil(np.sqrt(n)))
    q = -(-n // p)
    keys = [(seed * 0x9E3779B97F4A7C15 + k * 0xD1B54A32D192ED03) % (1 << 64) for k in range(1, rounds + 1)]

    def once(v: np.ndarray) -> np.ndarray:
        left, right = v // q, v % q
        for k, key in enumerate(keys):
            half = (right if k % 2 == 0 else left).astype(np.uint64) + np.uint64(key)
            half ^= half >> np.uint64(33)
            half *= np.uint64(0xFF51AFD7ED558CCD)
            half ^= half >> np.uint64(29)
            half *= np.uint64(0xC4CEB9FE1A85EC53)
            half ^= half >> np.uint64(32)
            if k % 2 == 0:
                left = (left + (half % np.uint64(p)).astype(np.int64)) % p
            else:
                right = (right + (half % np.uint64(q)).astype(np.int64)) % q
        return left * q + right

    out = once(np.asarray(x, np.int64))
    while (over := np.flatnonzero(out >= n)).size:
        out[over] = once(out[over])
    return out


def number_rows(df: DataFrame, order: list[str], name: str = "row_number", bins: int | None = None) -> DataFrame:
    """Adds the global row number (from 0) in the given order without one task seeing all rows.

    Rows are range-partitioned and sorted, and written with their partition's number; the offsets come
    from one count for each partition, BINS at most. Rows that tie in order may change places between
    runs over different inputs, never within one result; ranges can't divide them.
    """
    bins = bins or min(BINS, max(4, df.count() // BIN_ROWS))
    ranged = df.repartitionByRange(bins, *order).sortWithinPartitions(*order)
    kept = materialize(ranged.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "numbered")
    before = kept.groupBy("_part").agg(F.count("*").alias("_n")).withColumn("_before", F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    offsets = before.select("_part", F.coalesce("_before", F.lit(0)).alias("_before"))  # a row for each bin
    return kept.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def shard_documents(docs: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Law `rows`: each document's shard and slot, computed from its permuted global row number.

    Global rows are numbered by (doc_id, text checksum, size), and rows that agree in these by a hash of
    their address, so that ranges can divide them, however many there are. With permuted number v, shard is v mod
    shards and slot is v div shards: shards differ by one row at most and slots have no gaps.

    A null text has size 1 and the checksum of the empty text; a null doc_id sorts first; repeated rows
    each get a place of their own; an empty table gives an empty result. Other columns are not read.
    """
    body = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    docs = scanned(docs, ["doc_id", "text"])
    tie = F.xxhash64("_metadata.file_path", "_metadata.row_index").alias("_tie")
    rows = docs.select(F.col("doc_id"), tie, (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).cast("long").alias("text_crc32"))
    numbered = number_rows(rows, ["doc_id", "text_crc32", "size", "_tie"], "_row")
    n = numbered.count()

    @F.pandas_udf("long")
    def permuted(v: pd.Series) -> pd.Series:
        return pd.Series(feistel(v.to_numpy(np.int64), n, seed))

    placed = numbered.withColumn("_v", permuted("_row"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("_v") % shards).cast("int").alias("shard"),
        F.floor(F.col("_v") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("_row").alias("global_row"),
    )


def op10_feistel_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read_table(spark, sf_dir, "documents"))
