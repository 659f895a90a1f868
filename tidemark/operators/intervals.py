"""Intervals: change points, differences, membership and overlaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scan import BUCKET_US, following, highest, last, scan, time_bucket, total
from tidemark.sources.scratch import stored


def change_points(points: DataFrame, key: str, time: str, value: str, end: Column | None = None, bucket_us: int = BUCKET_US) -> DataFrame:
    """Change points become intervals [start_us, end_us) with their value; the last one ends at `end` (or at itself)."""
    ends = end if end is not None else F.col(time)
    ahead = scan(points, [key], [time], time_bucket(time, bucket_us), {"_after": following(time)})
    return ahead.select(key, F.col(time).alias("start_us"), F.coalesce(F.col(f"_after.{time}"), ends).alias("end_us"), F.col(value).alias("value"))


def subtract(valid: DataFrame, bad: DataFrame, key: str = "subject_id", bucket_us: int = BUCKET_US) -> DataFrame:
    """Parts of valid intervals (key, segment, start_us, end_us) that no bad interval (key, start_us, end_us) covers.

    Overlapping valid segments go to the earliest one: each is cut back to what lies after the latest end
    before it. Then one sweep over each key's boundaries: the number of open bad intervals is a running
    sum, the segment at hand is carried along. No pair of intervals is formed; no piece is empty. Sweeps go
    bucket by bucket of time, so a key may hold any share of the rows.
    """
    seen = scan(valid.where("end_us > start_us").select(key, "segment", "start_us", "end_us"), [key], ["start_us", "segment"], time_bucket("start_us", bucket_us), {"_before": highest("end_us", own=False)})
    own = seen.select(key, "segment", F.greatest("start_us", F.coalesce("_before", "start_us")).alias("start_us"), "end_us")
    none = F.lit(None).cast(valid.schema["segment"].dataType)
    point = lambda t, d, begins, segment: F.struct(F.col(t).alias("t"), F.lit(d).alias("d"), F.lit(begins).alias("begins"), segment.alias("segment"))
    steps = own.where("end_us > start_us").select(key, F.explode(F.array(point("start_us", 0, 1, F.col("segment")), point("end_us", 0, 0, none))).alias("e"))
    steps = steps.unionByName(bad.where("end_us > start_us").select(key, F.explode(F.array(point("start_us", 1, None, none), point("end_us", -1, None, none))).alias("e")))
    # at one time a beginning overrides an end
    net = stored(steps.groupBy(key, F.col("e.t").alias("t")).agg(F.sum("e.d").alias("d"), F.max("e.begins").alias("begins"), F.max("e.segment").alias("segment")), "sweep")
    begun = F.when(F.col("begins").isNotNull(), F.struct("begins", "segment"))
    swept = scan(net, [key], ["t"], time_bucket("t", bucket_us), {"_after": following("t"), "bad": total("d"), "s": last(begun)})
    swept = swept.select(key, F.col("t").alias("start_us"), F.col("_after.t").alias("end_us"), "bad", "s")
    owned = swept.where("s.begins = 1 and bad = 0 and end_us > start_us").select(key, "s.segment", "start_us", "end_us")
    # pieces don't overlap, so those that follow each other without a gap have the same start less all lengths before
    pieces = owned.withColumn("_length", F.col("end_us") - F.col("start_us"))
    joined = scan(pieces, [key, "segment"], ["start_us"], time_bucket("start_us", bucket_us), {"_passed": total("_length", own=False)})
    joined = joined.withColumn("_run", F.col("start_us") - F.coalesce("_passed", F.lit(0)))
    return joined.groupBy(key, "segment", "_run").agg(F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us")).drop("_run")


def with_samples(pieces: DataFrame, segments: DataFrame, key: str = "subject_id") -> DataFrame:
    """Adds each piece's length in samples and its start index, from its segment's start, start index and frequency."""
    s = segments.select(key, "segment", F.col("start_us").alias("_s"), "startidx", "frequency")
    joined = pieces.join(s, [key, "segment"])
    rate = F.col("frequency") / 1e6
    return joined.withColumns({"length": F.round((F.col("end_us") - F.col("start_us")) * rate).cast("long"), "startidx": (F.col("startidx") + F.round((F.col("start_us") - F.col("_s")) * rate)).cast("long")}).drop("_s")


def assign(points: DataFrame, segments: DataFrame, key: str = "subject_id", bucket_us: int | None = None) -> DataFrame:
    """Each point (key, ts_us) with the first segment that has start_us <= ts_us < end_us; others go.

    bucket_us adds a time bucket to the join's key, which splits keys that hold very many rows.
    """
    seg = segments.select(key, "segment", "start_us", "end_us")
    on = [key]
    if bucket_us:
        bucket = lambda c: F.floor(F.col(c) / bucket_us)
        points = points.withColumn("_bucket", bucket("ts_us"))
        seg = seg.withColumn("_bucket", F.explode(F.sequence(bucket("start_us"), bucket("end_us"))))
        on = [key, "_bucket"]
    found = points.join(seg, on).where("start_us <= ts_us and ts_us < end_us")
    first = found.groupBy(*[c for c in points.columns if c != "_bucket"]).agg(F.min(F.struct("start_us", "segment", "end_us")).alias("_s"))
    return first.select(*[c for c in points.columns if c != "_bucket"], "_s.segment", "_s.start_us", "_s.end_us")


def overlapping(segments: DataFrame, key: str = "subject_id", bucket_us: int = BUCKET_US) -> DataFrame:
    """key, segments, overlaps: how many segments end after the next one starts."""
    ahead = scan(segments.select(key, "segment", "start_us", "end_us"), [key], ["start_us", "segment"], time_bucket("start_us", bucket_us), {"_after": following("start_us")})
    flagged = ahead.withColumn("_late", F.col("end_us") > F.col("_after.start_us"))
    return flagged.groupBy(key).agg(F.count("*").alias("segments"), F.count_if("_late").alias("overlaps"))
