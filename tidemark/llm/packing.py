"""Harmonic packing of tokenized documents into fixed-length sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import materialize, power_of_two, read_table
from tidemark.llm.textarrays import column
from tidemark.llm.tokens import END, crc, default_path, encoder, packed

CAPACITY = 2048
#: Remainders of at least so many tokens are cut at the next class's size; shorter ones stay whole.
CUT_FROM = 64
#: Pieces of one group; groups fill their bins independently of each other.
GROUP_PIECES = 20_000


def cut(n: int, capacity: int = CAPACITY, cut_from: int = CUT_FROM) -> list[int]:
    """Lengths of the pieces of a document of n tokens.

    Full sequences first. A remainder r lies in class j (capacity/(j+1) < r <= capacity/j); unless it
    nearly fills that class's share, floor(capacity/(j+1)) of it goes to class j+1 exactly, and the
    small rest is treated alike.
    """
    pieces = [capacity] * (n // capacity)
    r = n % capacity
    while r:
        j = capacity // r
        if r < cut_from or capacity // j == r or j * r >= capacity - capacity // 64:
            pieces.append(r)
            break
        pieces.append(capacity // (j + 1))
        r -= capacity // (j + 1)
    return pieces


def pieces_of(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids_crc32, doc_tokens, class (documents a bin), and ids if asked."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, class int" + (", ids array<int>" if keep_ids else "")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            data, offsets = column(batch.column(1))
            raw, rows = data.tobytes(), []
            ids_of = batch.column(0).to_pylist()
            for i, doc_id in enumerate(ids_of):
                ids = encode(raw[offsets[i] : offsets[i + 1]].decode("utf-8", "replace"))
                ids.append(END)
                flat, start = packed(ids), 0
                for size in cut(len(ids), capacity):
                    part = [ids[start : start + size]] if keep_ids else []
                    rows.append((doc_id, start, size, crc(flat[4 * start : 4 * (start + size)]), len(ids), capacity // size, *part))
                    start += size
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    types = [pa.int64()] * 5 + [pa.int32()] + [pa.list_(pa.int32())] * keep_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(work, schema)


def first_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length, longest first into the first bin with room."""
    room: list[int] = []
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    low = 0  # bins before it are full
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        k = next((b for b in range(low, len(room)) if room[b] >= size), len(room))
        if k == len(room):
            room.append(capacity)
        bins[i], offsets[i] = k, capacity - room[k]
        room[k] -= size
        while low < len(room) and not room[low]:
            low += 1
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (length, class and any other columns).

    Pieces are dealt to groups by a hash of a key that is written down with them; within a group and
    class every run of `class` pieces fills one bin, so groups fill bins independently. What is left of
    each group and class, less than one bin, is numbered on through prefix sums over the small table of
    leftover counts and fills bins of the same class across groups; the last unfilled bin of each class
    (under CAPACITY * (1 + ln CUT_FROM) pieces in all, whatever the input) is packed first-fit.
    """
    kept = materialize(pieces.withColumn("_key", F.monotonically_increasing_id()), "pieces")
    groups = power_of_two(kept.count() / GROUP_PIECES, 8)
    kept = kept.withColumn("_group", F.pmod(F.xxhash64("_key"), F.lit(groups)))
    order = Window.partitionBy("_group", "class").orderBy("_key")
    ranked = kept.withColumn("_rank", F.row_number().over(order) - 1)
    counts = kept.groupBy("_group", "class").agg(F.count("*").alias("_n")).withColumn("_left", F.col("_n") % F.col("class"))
    over = Window.partitionBy("class").orderBy("_group")
    counts = materialize(
        counts.withColumn("_full", F.col("_n") - F.col("_left"))
        .withColumn("_left_before", F.sum("_left").over(over) - F.col("_left"))
        .withColumn("_bins_before", F.floor((F.sum("_full").over(over) - F.col("_full")) / F.col("class")))
        .withColumn("_left_all", F.sum("_left").over(Window.partitionBy("class")))
        .withColumn("_bins_all", F.floor(F.sum("_full").over(Window.partitionBy("class")) / F.col("class"))),
        "counts",
    )  # a row for each group and class; pieces are already dealt by both, so they needn't move for this join
    joined = ranked.join(counts, ["_group", "class"])
    joined = joined.withColumn("_late", F.col("_left_before") + F.col("_rank") - F.col("_full"))
    main = F.col("_rank") < F.col("_full")
    per_class = F.col("class").cast("long")
    second = ~main & (F.col("_late") < F.col("_left_all") - F.col("_left_all") % per_class)
    joined = joined.withColumns({
        "_bin": F.when(main, F.col("_bins_before") + F.floor(F.col("_rank") / per_class)).when(second, F.col("_bins_all") + F.floor(F.col("_late") / per_class)),
        "_slot": F.when(main, F.col("_rank") % per_class).when(second, F.col("_late") % per_class),
    })
    written = materialize(joined.drop("_n", "_left", "_full", "_left_before", "_bins_before", "_left_all", "_bins_all", "_late", "_rank", "_group"), "placed")
    # bin numbers of class c follow those of the classes before it
    bins = written.where("_bin is not null").groupBy("class").agg((F.max("_bin") + 1).alias("_bins"))
    bins = bins.withColumn("_first", F.sum("_bins").over(Window.orderBy("class")) - F.col("_bins"))  # at most CAPACITY rows
    filled = written.where("_bin is not null").join(F.broadcast(bins.drop("_bins")), "class")
    inside = Window.partitionBy("_first", "_bin").orderBy("_slot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = filled.withColumns({"sequence_id": F.col("_first") + F.col("_bin"), "offset": F.sum("length").over(inside) - F.col("length")}).drop("_first")
    total = int(bins.agg(F.sum("_bins")).first()[0] or 0)
    rest = written.where("_bin is null")
    schema = rest.select("_key", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset")).schema

    def tail(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_key")
        b, o = first_fit(pdf["length"].to_numpy(), capacity)
        return pd.DataFrame({"_key": pdf["_key"], "sequence_id": total + b, "offset": o})

    placed = rest.select("_key", "length").groupBy(F.lit(0).alias("_all")).applyInPandas(tail, schema)
    rest = rest.join(F.broadcast(placed), "_key")  # bounded: unfilled bins of each class
    return filled.unionByName(rest).drop("_bin", "_slot", "_key")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of at most `capacity` tokens.

    Lengths are partitioned into reciprocal-capacity classes; a bin of class j takes j pieces. Documents
    are cut so that pieces nearly fill their class's share (see cut()). Every id lies in exactly one piece.

    A null text is the empty text: one piece with the end id alone. Repeated rows are packed as often as
    they occur; a null doc_id stays null; an empty table gives an empty result. Other columns are not read.
    keep_ids adds each piece's ids.
    """
    return pack_pieces(pieces_of(docs, tokenizer or default_path(), capacity, keep_ids), capacity)


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = pack_documents(read_table(spark, sf_dir, "documents"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("class").alias("bin_documents"))
