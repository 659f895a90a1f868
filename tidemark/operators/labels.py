"""Inside / outside labels of windows against limits that change over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import finite
from tidemark.operators.windows import look_back


def mean_rule(df: DataFrame, mean: str = "mean", lower: str = "lower", upper: str = "upper") -> Column:
    """Inside if the window's mean lies between the limits, both included; null if anything is missing."""
    return F.col(mean).between(F.col(lower), F.col(upper))


def count_rule(windowed: DataFrame, keys: list[str], n_expected: Column, rule: str = "count", percentage: float = 0.5) -> DataFrame:
    """keys, inside: whether most samples lie inside; null while the margin is below the missing share.

    windowed: one row a sample with value, lower, upper and keys. n_expected: samples a full window has.
    rule "count" compares the margin's size; "count_signed" its sign too.
    """
    good = finite("value") & F.col("lower").isNotNull() & F.col("upper").isNotNull()
    inside = F.col("value").between(F.col("lower"), F.col("upper"))
    g = windowed.groupBy(*keys).agg(F.count_if(good & inside).alias("n_in"), F.count_if(good & ~inside).alias("n_out"), F.max(n_expected).alias("n_expected"))
    n = F.col("n_expected").cast("double")
    g = g.withColumns({"share_in": F.try_divide("n_in", n), "share_out": F.try_divide("n_out", n)})
    missing = 1 - F.col("share_in") - F.col("share_out")
    margin = F.col("share_in") - F.col("share_out")
    margin = F.abs(margin) if rule == "count" else margin
    return g.withColumn("inside", F.when((margin >= missing) & (F.col("n_in") + F.col("n_out") > 0), F.col("share_in") / (F.col("share_in") + F.col("share_out")) > percentage))


def smooth_rule(steps: DataFrame, key: str, time: str, n: int, step_us: int, smooth_frac: float = 0.46, r2_min: float | None = None) -> DataFrame:
    """Adds inside: at most smooth_frac of the last n steps' means lie outside their own limits.

    steps: one row a step with mean, lower, upper (and r2). Null unless all n steps are there, one step
    apart, with limits and means (and r2 of at least r2_min if that is above 0).
    """
    out = (~F.col("mean").between(F.col("lower"), F.col("upper"))).cast("double")
    aggregates = {"_out": F.avg(out), "_known": F.count(out)}
    if r2_min:
        aggregates["_r2"] = F.min("r2")
    looked = look_back(steps, key, time, n, step_us, aggregates)
    good = F.col("_known") == n
    if r2_min:
        good &= F.col("_r2") >= r2_min
    return looked.withColumns({"share_outside": F.when(good, F.col("_out")), "inside": F.when(good, F.col("_out") <= smooth_frac)}).drop(*aggregates)


def inside_share(df: DataFrame, key: str, inside: str = "inside", length: str = "length") -> DataFrame:
    """key, share_inside, share_outside, weighted by length; rows without a label don't count."""
    known = F.col(inside).isNotNull()
    share = F.try_divide(F.sum(F.when(known, F.col(inside).cast("int") * F.col(length))), F.sum(F.when(known, F.col(length))))
    return df.groupBy(key).agg(share.alias("share_inside")).withColumn("share_outside", 1 - F.col("share_inside"))
