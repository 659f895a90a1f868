"""Runs, episodes, sessions and rolling fractions of ordered series; a key may hold any share of the rows (functions.scan)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scan import BUCKET_US, previous, scan, time_bucket, total, with_halo


def run_ids(df: DataFrame, key: str, order: list[str], value: str, name: str = "run", bucket_us: int = BUCKET_US) -> DataFrame:
    """Numbers the runs of equal values (nulls are equal) of each key from 1."""
    seen = scan(df, [key], order, time_bucket(order[0], bucket_us), {"_before": previous(value)})
    changed = F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col(f"_before.{value}"))
    return scan(seen.withColumn("_new", changed.cast("int")), [key], order, time_bucket(order[0], bucket_us), {name: total("_new")}).drop("_new", "_before")


def outside_episodes(df: DataFrame, key: str, order: list[str], flag: str, step_us: int, bucket_us: int = BUCKET_US) -> DataFrame:
    """Maximal runs of a true flag: start is the time before the run (or one step earlier), end its last time.

    A run's first row is one whose flag is true and that of the row before isn't; rows count their run's first ones.
    """
    t, bucket = order[0], time_bucket(order[0], bucket_us)
    seen = scan(df, [key], order, bucket, {"_before": previous(t, flag)})
    changed = F.col("_before").isNull() | ~F.col(flag).eqNullSafe(F.col(f"_before.{flag}"))
    start = F.coalesce(F.col(f"_before.{t}"), F.col(t) - step_us)
    runs = scan(seen.withColumns({"_new": changed.cast("int"), "_start": start}), [key], order, bucket, {"run": total("_new")}).where(F.col(flag))
    return runs.groupBy(key, "run").agg(F.min("_start").alias("start_us"), F.max(t).alias("end_us"), F.count("*").alias("n")).withColumn("duration_us", F.col("end_us") - F.col("start_us"))


def episode_stats(episodes: DataFrame, key: str, duration: str, recorded_us: DataFrame | None = None) -> DataFrame:
    """Count, mean, median, sample deviation, extremes, and episodes for each hour recorded (key, recorded_us)."""
    d = F.col(duration) / 60e6
    out = episodes.groupBy(key).agg(F.count("*").alias("episodes"), F.avg(d).alias("mean_min"), F.median(d).alias("median_min"), F.stddev_samp(d).alias("std_min"), F.max(d).alias("max_min"), F.min(d).alias("min_min"))
    if recorded_us is not None:
        out = out.join(recorded_us, key).withColumn("per_hour", F.try_divide(F.col("episodes") * 3600e6, F.col("recorded_us"))).drop("recorded_us")
    return out


def sessionize(df: DataFrame, key: str, order: list[str], gap_us: int, value: str | None = None, name: str = "cluster", bucket_us: int = BUCKET_US) -> DataFrame:
    """Clusters, from 0: a new one after a gap of more than gap_us, or where value is null."""
    t, bucket = order[0], time_bucket(order[0], bucket_us)
    new = F.coalesce(F.col(t) - F.col(f"_before.{t}") > gap_us, F.lit(False))
    if value:
        new = new | F.col(value).isNull()
    seen = scan(df, [key], order, bucket, {"_before": previous(t)}).withColumn("_new", new.cast("int"))
    return scan(seen, [key], order, bucket, {name: total("_new")}).drop("_new", "_before")


def rolling_inside(df: DataFrame, keys: list[str], time: str, out: str, window_us: int, least: int, bucket_us: int = BUCKET_US) -> DataFrame:
    """Share inside over (t - window, t] within keys, where at least `least` rows count."""
    w = Window.partitionBy(*keys, "_bucket").orderBy(time).rangeBetween(-window_us + 1, 0)
    rolled = with_halo(df, time, window_us, bucket_us).withColumns({"n": F.count(out).over(w), "frac_in": 1 - F.avg(F.col(out).cast("double")).over(w)})
    return rolled.where((F.col("n") >= least) & ~F.col("_halo")).drop("_bucket", "_halo")


def by_elapsed(df: DataFrame, start: DataFrame, key: str, time: str, flag: str, step_us: int) -> DataFrame:
    """For each step since the key's start: rows whose flag is true, and that over all keys; empty steps are 0."""
    joined = df.join(start.select(key, F.col("start_us").alias("_start")), key)
    sums = joined.groupBy(F.floor((F.col(time) - F.col("_start")) / step_us).alias("step")).agg(F.count_if(flag).alias("outside"))
    total = start.agg(F.count_distinct(key).alias("_n"))
    grid = sums.agg(F.min("step").alias("a"), F.max("step").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("step"))
    full = grid.join(sums, "step", "left").join(F.broadcast(total))
    return full.select("step", F.coalesce("outside", F.lit(0)).alias("outside"), (F.coalesce("outside", F.lit(0)) / F.col("_n")).alias("outside_per_recording"))


def time_to_first(labels: DataFrame, recordings: DataFrame, key: str, columns: list[str], end: str | None = None) -> DataFrame:
    """Seconds from a recording's start_us to its first complete label row: 0 if earlier, null if none or not before `end`."""
    complete = F.lit(True)
    for c in columns:
        complete &= F.col(c).isNotNull()
    first = labels.where(complete).groupBy(key).agg(F.min("ts_us").alias("_first"))
    joined = recordings.join(first, key, "left")
    wait = F.greatest(F.lit(0), F.col("_first") - F.col("start_us")) / 1e6
    value = F.when(F.col("_first").isNotNull() & ((F.col("_first") < F.col(end)) if end else F.lit(True)), wait)
    return joined.select(key, value.alias("seconds_to_first"))


def trajectories(df: DataFrame, key: str, order: list[str], state: str, values: dict[str, Column], bucket_us: int = BUCKET_US) -> DataFrame:
    """One row a run of equal states: the state, its extent and aggregates."""
    runs = run_ids(df, key, order, state, bucket_us=bucket_us)
    return runs.groupBy(key, "run").agg(F.first(state).alias(state), F.min(order[0]).alias("start_us"), F.max(order[0]).alias("end_us"), *[a.alias(n) for n, a in values.items()])
