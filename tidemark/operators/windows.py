"""Look-back windows around label times: bounds, contents, thinning, imputation, regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import SECOND
from tidemark.functions.scan import BUCKET_US, first, following, last, lowest, scan, time_bucket, total, with_halo

#: Rows of a gap that one array holds.
GAP_ROWS = 4096


def bounds(t: str, mode: str, window_us: int) -> tuple[Column, Column]:
    """Start and end (exclusive) of the window of a label time: before, mean, smooth and count look back; after; within."""
    if mode in ("before", "mean", "smooth", "count"):
        start = F.col(t) - window_us
    elif mode == "after":
        start = F.col(t) - SECOND
    elif mode == "within":
        start = F.col(t) - (window_us // SECOND // 2) * SECOND
    else:
        raise ValueError(f"no such mode: {mode}")
    return start, start + window_us


def overlap(labels: DataFrame, mode: str, window_us: int, most: float) -> DataFrame:
    """Labels with their segment (start_us, end_us): window bounds, the part outside the segment and its share.

    Windows with a larger share than `most` outside go.
    """
    ws, we = bounds("ts_us", mode, window_us)
    out = labels.withColumns({"window_start": ws, "window_end": we})
    gap = F.greatest(F.lit(0), F.col("start_us") - F.col("window_start")) + F.greatest(F.lit(0), F.col("window_end") - F.col("end_us"))
    out = out.withColumn("gap_us", gap.cast("long")).withColumn("gap_share", F.col("gap_us") / window_us)
    return out.where(F.col("gap_share") <= most)


def samples_in(labels: DataFrame, signal: DataFrame, mode: str, window_us: int, key: str = "subject_id", salt: int = 1) -> DataFrame:
    """One row for each (label, sample in its window): key, ts_us, at_us, value.

    Both sides are cut into buckets as long as the window, so the join is on (key, bucket) and a window
    meets two buckets at most. salt deals a key's buckets of labels on to more tasks.
    """
    ws, we = bounds("ts_us", mode, window_us)
    bucket = lambda c: F.floor(c / window_us)
    wide = labels.withColumns({"_ws": ws, "_we": we}).withColumn("_b", F.explode(F.sequence(bucket(F.col("_ws")), bucket(F.col("_we") - 1))))
    samples = signal.select(key, F.col("ts_us").alias("at_us"), "value").withColumn("_b", bucket(F.col("at_us")))
    on = [key, "_b"]
    if salt > 1:
        wide = wide.withColumn("_salt", F.pmod(F.xxhash64("ts_us"), F.lit(salt)).cast("int"))
        samples = samples.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1))))
        on.append("_salt")
    return wide.join(samples, on).where("at_us >= _ws and at_us < _we").drop("_ws", "_we", "_b", "_salt")


def vectors(windowed: DataFrame, keys: list[str]) -> DataFrame:
    """Samples of each window as one array in time order."""
    packed = windowed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("at_us", "value"))).alias("_v"))
    return packed.select(*keys, F.transform("_v", lambda v: v["value"]).alias("x"))


def look_back(df: DataFrame, key: str, time: str, rows: int, step_us: int, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over a row and the rows - 1 before it; null unless they are all there, one step apart in all."""
    frame = Window.partitionBy(key, "_bucket").orderBy(time).rowsBetween(-(rows - 1), 0)
    whole = (F.count("*").over(frame) == rows) & (F.col(time) - F.first(time).over(frame) == (rows - 1) * step_us)
    seen = with_halo(df, time, (rows - 1) * step_us + 1).withColumns({name: F.when(whole, agg.over(frame)) for name, agg in aggregates.items()})
    return seen.where(~F.col("_halo")).drop("_bucket", "_halo")


def thin(labels: DataFrame, key: str, time: str, window_us: int, bucket_us: int | None = None) -> DataFrame:
    """Greedy thinning: the first time, then each next one at least a window after the last kept.

    A key's times lie in buckets of bucket_us (some windows' length). 1. Each bucket becomes a function: from
    the earliest time that may still be kept when the bucket begins to the earliest one after it. Only
    times within the bucket's first window can make a difference, so the function has no more steps than
    these. 2. Along a key the functions are applied one after the other; a bucket's function is all that is
    held. 3. Each bucket is thinned from the time that it then begins with. So a key is spread over its
    buckets, and what one task reads of a whole key are the steps.
    """
    import numpy as np
    import pyarrow as pa

    bucket_us = max(bucket_us or 64 * window_us, window_us)
    times = labels.select(key, F.col(time).cast("long").alias(time)).where(F.col(time).isNotNull()).withColumn("_bucket", F.call_function("div", F.col(time) - F.pmod(F.col(time), F.lit(bucket_us)), F.lit(bucket_us)))
    kind = times.schema[key].dataType.simpleString()

    def walk(t: np.ndarray, start: int) -> tuple[list[int], int]:
        """Places kept of sorted times from `start` on, and the earliest time that may be kept afterwards."""
        rows, i = [], int(np.searchsorted(t, start))
        while i < len(t):
            rows.append(i)
            start = int(t[i]) + window_us
            i = int(np.searchsorted(t, start))
        return rows, start

    def runs(batches, columns):
        """(key, bucket) and the named columns as arrays, one after the other, from rows in that order."""
        at, held = None, []
        for batch in batches:
            keys, buckets = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            arrays = [batch.column(c).to_numpy(zero_copy_only=False) for c in columns]
            cuts = [0, *(i for i in range(1, len(keys)) if (keys[i], buckets[i]) != (keys[i - 1], buckets[i - 1])), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                if a < b:
                    if held and at != (keys[a], buckets[a]):
                        yield *at, *(np.concatenate(c) for c in zip(*held))
                        held = []
                    at = (keys[a], buckets[a])
                    held.append([x[a:b] for x in arrays])
        if held:
            yield *at, *(np.concatenate(c) for c in zip(*held))

    def functions(batches):
        for k, b, t in runs(batches, [2]):
            t = np.unique(t)
            n = int(np.searchsorted(t, b * bucket_us + window_us)) + 1  # the first time past the window, too
            after = np.searchsorted(t, t + window_us)  # the next kept place of each
            at = np.arange(min(n, len(t)))
            while (further := after[at] < len(t)).any():
                at = np.where(further, after[at], at)
            t, leave = t[:n], t[at] + window_us
            change = np.flatnonzero(np.append(leave[1:] != leave[:-1], True))  # of times with one end the last tells
            yield pa.RecordBatch.from_pydict({"key": pa.array([k], types[0]), "bucket": [b], "upto": [t[change].tolist()], "leave": [leave[change].tolist()]}, schema=pa.schema([("key", types[0]), ("bucket", pa.int64()), ("upto", pa.list_(pa.int64())), ("leave", pa.list_(pa.int64()))]))

    def applied(batches):
        at, start = (), 0
        for batch in batches:
            starts = []
            for k, upto, leave in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3)):
                if (k,) != at:
                    at, start = (k,), -(1 << 62)
                starts.append(start)
                upto = upto.values.to_numpy()
                i = int(np.searchsorted(upto, start))
                if i < len(upto):
                    start = int(leave.values[i].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(starts, pa.int64())], ["key", "bucket", "start"])

    def kept(batches):
        for k, _, t in runs(batches, [2]):
            start = int(t[0])  # the bucket's first row is its start
            t = t[1:]
            found = t[walk(t, start)[0]]
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(found), types[0]), pa.array(found, pa.int64())], [key, time])

    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(times.schema[key].dataType)]
    ordered = times.select(key, "_bucket", time).repartition(key, "_bucket").sortWithinPartitions(key, "_bucket", time)
    steps = ordered.mapInArrow(functions, f"key {kind}, bucket long, upto array<long>, leave array<long>")
    starts = steps.repartition("key").sortWithinPartitions("key", "bucket").mapInArrow(applied, f"key {kind}, bucket long, start long")
    both = times.select(key, "_bucket", time, F.lit(1).alias("_edge")).unionByName(starts.select(F.col("key").alias(key), F.col("bucket").alias("_bucket"), F.col("start").alias(time), F.lit(0).alias("_edge")))
    both = both.repartition(key, "_bucket").sortWithinPartitions(key, "_bucket", "_edge", time)
    return both.mapInArrow(kept, labels.select(key, F.col(time).cast("long").alias(time)).schema)


def impute_linear(df: DataFrame, window: list[str], time: str, value: str, most_missing: float = 0.25, bucket_us: int = BUCKET_US) -> DataFrame:
    """Missing values on the line between their neighbours, ends held; windows with too many missing go."""
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(time).alias("t"), F.col(value).alias("v")))
    lacks = F.col(value).isNull().cast("int")
    near = scan(df, window, [time], time_bucket(time, bucket_us), {
        "_n0": total(), "_n1": total(own=False, ahead=True), "_m0": total(lacks), "_m1": total(lacks, own=False, ahead=True), "_a": last(known), "_b": first(known),
    })
    missing = (F.col("_m0") + F.coalesce("_m1", F.lit(0))) / (F.col("_n0") + F.coalesce("_n1", F.lit(0)))
    line = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col(time) - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    filled = F.when(F.col(value).isNotNull(), F.col(value)).when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull(), F.col("_a.v")).otherwise(line)
    return near.where(missing <= most_missing).where("_a is not null or _b is not null").withColumn(value, filled).drop("_n0", "_n1", "_m0", "_m1", "_a", "_b")


def gap_fill(segments: DataFrame, key: str = "subject_id", bucket_us: int = BUCKET_US) -> DataFrame:
    """Dense segments (key, segment_id, start_us, frequency, samples) as rows on their grid, with null rows in the gaps.

    rel_us counts from the key's first start.
    """
    step = F.round(F.lit(1e6) / F.col("frequency")).cast("long")
    s = scan(segments.withColumn("_step", step), [key], ["start_us"], time_bucket("start_us", bucket_us), {"_after": following("start_us"), "_zero": lowest("start_us")}).withColumn("_next", F.col("_after.start_us"))
    s = s.withColumn("_end", F.col("start_us") + F.size("samples") * F.col("_step"))
    rows = s.select(key, "_zero", "_step", "start_us", F.posexplode("samples").alias("_i", "value"))
    have = rows.select(key, (F.col("start_us") - F.col("_zero") + F.col("_i") * F.col("_step")).alias("rel_us"), "value")
    n = F.floor((F.col("_next") - F.col("_end")) / F.col("_step"))
    gaps = s.select(key, "_end", "_zero", "_step", n.alias("_n")).where("_n > 0")
    gaps = gaps.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(GAP_ROWS).cast("long"))))  # long gaps in pieces
    gaps = gaps.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_n"), F.col("_from") + GAP_ROWS) - 1)))
    empty = gaps.select(key, (F.col("_end") - F.col("_zero") + F.col("_i") * F.col("_step")).alias("rel_us"), F.lit(None).cast("double").alias("value"))
    return have.unionByName(empty)


def sample_offsets(segments: DataFrame, key: str, length: str, bucket_us: int = BUCKET_US) -> DataFrame:
    """Samples before each segment of its key."""
    before = scan(segments, [key], ["start_us"], time_bucket("start_us", bucket_us), {"offset": total(length, own=False)})
    return before.withColumn("offset", F.coalesce("offset", F.lit(0)).cast("long"))


def row_position(df: DataFrame, key: str, order: list[str], bucket_us: int = BUCKET_US) -> DataFrame:
    """Position of each row within its key, from 0; the first of `order` is a time or another number."""
    return scan(df, [key], order, time_bucket(order[0], bucket_us), {"position": total()}).withColumn("position", (F.col("position") - 1).cast("long"))


def slice_samples(segments: DataFrame, windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows (startidx, endidx) cut out of dense segments' samples arrays."""
    joined = windows.join(segments.select(*keys, "samples"), keys)
    return joined.withColumn("x", F.slice("samples", F.col("startidx") + 1, F.col("endidx") - F.col("startidx"))).drop("samples")
