"""Cohort statistics: distributions, correlations, false-discovery control, group summaries."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranged import exact_percentiles, joined, least_ahead, parts_for, running_sums
from tidemark.sources.scratch import stored


def describe(df: DataFrame, value: str, by: list[str] | None = None, percentiles: tuple[float, ...] = (0.25, 0.5, 0.75, 0.9)) -> DataFrame:
    """Count, mean, sample deviation, extremes and exact percentiles (null where a group has no values)."""
    by, c = by or [], F.col(value).cast("double")
    plain = df.groupBy(*by).agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = exact_percentiles(df, c, list(percentiles), by)
    # a group without values has no percentiles; null groups are equal
    q = q.unionByName(plain.where("n = 0").select(*by, F.lit(None).cast("array<double>").alias("q")))
    both = joined(plain, q, by) if by else plain.join(F.broadcast(q))
    return both.select(*by, "n", "mean", "std", "min", *[F.get("q", F.lit(k)).alias(f"p{round(100 * p)}") for k, p in enumerate(percentiles)], "max")


def value_share(df: DataFrame, value: str) -> DataFrame:
    """value, n, share of all rows. The window runs over the counted values only."""
    counts = df.groupBy(value).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("_all"))
    return counts.join(F.broadcast(total)).withColumn("share", F.col("n") / F.col("_all")).drop("_all")


def histogram(df: DataFrame, value: str, bins: int, by: list[str] | None = None, lo: float | None = None, hi: float | None = None) -> DataFrame:
    """bin, left edge, n and share in `bins` equal bins; the last is closed, values outside lo..hi don't count.

    Without lo and hi the bins span the (group's) values; groups meet their edges in a broadcast of one row a group.
    """
    by = by or []
    v = F.col(value).cast("double")
    edges = df.groupBy(*by).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    if lo is not None:
        edges = edges.withColumns({"_lo": F.lit(float(lo)), "_hi": F.lit(float(hi))})
    joined = df.join(edges, by) if by else df.join(F.broadcast(edges))
    inside = joined.where(v.between(F.col("_lo"), F.col("_hi")))
    width = (F.col("_hi") - F.col("_lo")) / bins
    k = F.when(width > 0, F.least(F.floor((v - F.col("_lo")) / F.when(width > 0, width)), F.lit(bins - 1))).otherwise(0)
    counts = inside.groupBy(*by, k.cast("int").alias("bin"), (F.col("_lo") + k * width).alias("left_edge")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("share", F.col("n") / total)  # at most `bins` rows a group


def histogram_mean(hist: DataFrame, by: list[str] | None = None) -> DataFrame:
    """The mean as a histogram has it: shares times left edges."""
    return hist.groupBy(*(by or [])).agg(F.sum(F.col("share") * F.col("left_edge")).alias("hist_mean"))


def coverage(signal: DataFrame, key: str = "subject_id") -> DataFrame:
    """variable, subjects, percent of subjects."""
    total = signal.agg(F.count_distinct(key).alias("_n"))
    per = signal.groupBy("variable").agg(F.count_distinct(key).alias("subjects"))
    return per.join(F.broadcast(total)).withColumn("percent", 100 * F.col("subjects") / F.col("_n")).drop("_n")


def moments(df: DataFrame, value: str) -> DataFrame:
    c = F.col(value).cast("double")
    return df.agg(F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"), F.count(c).alias("n"))


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """x, y, r of all pairs over rows where both have values: one pass, one row, then unpivoted."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    one = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], [f"{a}|{b}" for a, b in pairs], "pair", "r")
    return long.select(F.split("pair", r"\|")[0].alias("x"), F.split("pair", r"\|")[1].alias("y"), "r")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """Regularized incomplete beta function by its continued fraction (modified Lentz)."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    c, d = 1.0, 1 / max(1e-300, abs(1 - (a + b) * x / (a + 1))) * (1 if 1 - (a + b) * x / (a + 1) >= 0 else -1)
    f = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or 1e-300)
            c = (1 + num / c) or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def pearson_pvalue(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """x, y, n, r and the two-sided p of r under no correlation; rows missing either value don't count.

    Moments come from one pass; the p of each pair is worked out on the one row that leaves it.
    """
    aggregates = []
    for i, (a, b) in enumerate(pairs):
        x, y = F.col(a).cast("double"), F.col(b).cast("double")
        aggregates += [F.corr(x, y).alias(f"r{i}"), F.count_if(x.isNotNull() & y.isNotNull()).alias(f"n{i}")]
    row = df.agg(*aggregates).first()
    out = []
    for i, (a, b) in enumerate(pairs):
        r, n = row[f"r{i}"], row[f"n{i}"]
        p = None
        if r is not None and n > 2:
            p = 0.0 if abs(r) >= 1 else incomplete_beta((n - 2) / 2, 0.5, 1 - r * r)
        out.append((a, b, n, r, p))
    return df.sparkSession.createDataFrame(out, "x string, y string, n long, r double, p double")


def benjamini_hochberg(df: DataFrame, p: str, by: list[str] | None = None, name: str = "q", parts: int | None = None) -> DataFrame:
    """Adjusted p: p * n / rank, made monotone from the largest p down, at most 1; null p stay null.

    With `by` each group is a family. Equal p share the rank of their last one, so each different p is counted,
    ranked and adjusted once, range by range, and told to the rows that have it.
    """
    by = by or []
    known = stored(df.where(F.col(p).isNotNull()), "known")  # read twice
    rest = df.where(F.col(p).isNull()).withColumn(name, F.lit(None).cast("double"))
    counts = stored(known.groupBy(*by, p).agg(F.count("*").alias("_n")), "counts")
    parts = parts or parts_for(counts, by)
    ranked = running_sums(counts, p, ["_n"], by, parts)
    raw = stored(ranked.select(*by, p, (F.col(p) * F.col("all__n") / (F.col("below__n") + F.col("_n"))).alias("_raw")), "raw")
    adjusted = least_ahead(raw, p, "_raw", "_least", by, parts).select(*by, p, F.least(F.lit(1.0), "_least").alias(name))
    return joined(known, adjusted, [*by, p]).unionByName(rest)


def conditional_share(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """condition, n, share of all rows."""
    counts = df.agg(F.count("*").alias("_all"), *[F.count_if(c).alias(n) for n, c in conditions.items()])
    return counts.unpivot(["_all"], list(conditions), "condition", "n").withColumn("share", F.try_divide("n", "_all")).drop("_all")


def ci_halfwidth(std: str, n: int = 15, z: float = 1.96) -> Column:
    return F.col(std) / F.sqrt(F.lit(float(n))) * z


def best_per_group(df: DataFrame, by: list[str], metric: str, ties: list[str]) -> DataFrame:
    """The row with the highest metric of each group, and the group's mean; ties go to the first by `ties`."""
    w = Window.partitionBy(*by).orderBy(F.col(metric).desc_nulls_last(), *ties)
    ranked = df.withColumns({"_k": F.row_number().over(w), f"{metric}_group_mean": F.avg(metric).over(Window.partitionBy(*by))})
    return ranked.where("_k = 1").drop("_k")


def duration_by_part(recordings: DataFrame, key: str, patient: Column, length: str, frequency: str) -> DataFrame:
    """patient, parts, seconds with and without gaps over all parts of a patient."""
    return recordings.groupBy(patient.alias("patient")).agg(
        F.count_distinct(key).alias("parts"), F.sum((F.col("end_us") - F.col("start_us")) / 1e6).alias("seconds_with_gaps"), F.sum(F.col(length) / F.col(frequency)).alias("seconds_without_gaps")
    )
