"""Cleaning: sentinels, implausible values, casts, rejects and expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import finite


def sentinel_to_null(df: DataFrame, value: str, sentinel) -> DataFrame:
    return df.withColumn(value, F.nullif(F.col(value), F.lit(sentinel)))


def null_to_sentinel(df: DataFrame, value: str, sentinel) -> DataFrame:
    return df.withColumn(value, F.coalesce(F.col(value), F.lit(sentinel)))


def implausible_to_null(df: DataFrame, value: str, least: float = 0.0) -> DataFrame:
    """Values that no living subject has (at most `least`) become null."""
    return df.withColumn(value, F.when(F.col(value) > least, F.col(value)))


def missing_share(value: str) -> Column:
    """Aggregate: share of values that are null or NaN."""
    return F.avg((~finite(value)).cast("int"))


def in_range(value: str, lower: str, upper: str) -> Column:
    """Inclusive at both ends; null if any of the three is."""
    return F.col(value).between(F.col(lower), F.col(upper))


def reject_all_null(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose every listed column has a value somewhere."""
    counts = df.groupBy(key).agg(*[F.count(c).alias(c) for c in columns])
    return counts.where(reduce(lambda a, b: a & b, [F.col(c) > 0 for c in columns])).select(key)


def require_variable(recordings: DataFrame, signal: DataFrame, variable: str, key: str = "subject_id") -> DataFrame:
    """Recordings whose signal has the variable."""
    return recordings.join(signal.where(F.col("variable") == variable).select(key), key, "left_semi")


def flag_missing(recordings: DataFrame, signal: DataFrame, variable: str, flag: str, key: str = "subject_id") -> DataFrame:
    """Adds a flag: the recording lacks the variable."""
    have = signal.where(F.col("variable") == variable).select(key).distinct().withColumn("_has", F.lit(True))
    return recordings.join(have, key, "left").withColumn(flag, F.col("_has").isNull()).drop("_has")


def period_overlap(recordings: DataFrame, labels: DataFrame, key: str = "subject_id") -> DataFrame:
    """Recordings [start_us, end_us] that meet their labels' period."""
    period = labels.groupBy(key).agg(F.min("ts_us").alias("_first"), F.max("ts_us").alias("_last"))
    return recordings.join(period, key).where("end_us >= _first and start_us <= _last").drop("_first", "_last")


def prevalence(signal: DataFrame, key: str = "subject_id") -> DataFrame:
    """variable, recordings, share of all recordings that have it."""
    total = signal.agg(F.count_distinct(key).alias("_n"))
    per = signal.groupBy("variable").agg(F.count_distinct(key).alias("recordings"))
    return per.join(F.broadcast(total)).withColumn("share", F.col("recordings") / F.col("_n")).drop("_n")


def near_equal_count(x: str, y: float = 0.0, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Aggregate: how many values are close to y."""
    return F.count_if(F.abs(F.col(x) - y) <= atol + rtol * abs(y))


def mean_fill(df: DataFrame, columns: list[str]) -> DataFrame:
    """Missing values become their column's mean (one aggregate, one row sent to the tasks)."""
    means = df.agg(*[F.avg(c).alias(f"_{c}") for c in columns])
    filled = df.join(F.broadcast(means))
    return filled.withColumns({c: F.coalesce(F.col(c), F.col(f"_{c}")) for c in columns}).drop(*[f"_{c}" for c in columns])


def blank_to_code(text: str, code: int = -1) -> Column:
    """Blank or unreadable texts become a code."""
    return F.coalesce(F.expr(f"try_cast(nullif(trim({text}), '') as int)"), F.lit(code))


def expect(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """rule, violations: rows for which a rule is false or null. One pass over df."""
    counts = df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])
    return counts.unpivot([], list(rules), "rule", "violations")
