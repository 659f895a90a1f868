"""Running sums, exact percentiles and ranks of large groups, range by range, so that no task orders a whole group."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources.scratch import folder

#: Rows meant for one range, and ranges of a group at most.
PART_ROWS, MOST_PARTS = 1 << 16, 4096
#: Values of a group that one aggregate holds.
HELD = 1 << 16


def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Inner join on columns where nulls are equal; right gives its other columns."""
    named = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in on])
    return left.join(named, same).drop(*[f"_r_{c}" for c in on])


def parts_for(rows: DataFrame, by: list[str] | None = None) -> int:
    """How many ranges the largest group needs."""
    sizes = rows.groupBy(*(by or [])).agg(F.count("*").alias("_n"))
    return min(MOST_PARTS, max(1, -(-(sizes.agg(F.max("_n")).first()[0] or 1) // PART_ROWS)))


def _cut(rows: DataFrame, value: str, key: list[str], parts: int) -> DataFrame:
    """Adds _part: ranges of each group's values at approximate quantiles."""
    cuts = rows.groupBy(*key).agg(F.percentile_approx(value, F.array(*[F.lit(k / parts) for k in range(1, parts)]), F.lit(max(1000, 8 * parts))).alias("_cuts"))
    return joined(rows, cuts, key).withColumn("_part", F.size(F.filter("_cuts", lambda c: F.col(value) > c))).drop("_cuts")


def running_sums(counts: DataFrame, value: str, sums: list[str], by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds below_<c> (the sum of c over rows of the group with a smaller value) and all_<c> (of the whole group).

    counts: one row for each group and value. Values are cut into ranges of about PART_ROWS rows at
    approximate quantiles; each range is summed on its own, and one row a group and range carries what lies below it.
    """
    by = list(by or [])
    named = counts if by else counts.withColumn("_one", F.lit(0))
    key = by or ["_one"]
    parts = parts or parts_for(counts, by)
    if parts == 1:
        below, every = Window.partitionBy(*key).orderBy(value).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
        return named.withColumns({f"below_{c}": F.coalesce(F.sum(c).over(below), F.lit(0)) for c in sums} | {f"all_{c}": F.sum(c).over(every) for c in sums}).drop("_one")
    cut = _cut(named, value, key, parts)
    before, every = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)
    offsets = cut.groupBy(*key, "_part").agg(*[F.sum(c).alias(f"_s_{c}") for c in sums])
    offsets = offsets.select(*key, "_part", *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_b_{c}") for c in sums], *[F.sum(f"_s_{c}").over(every).alias(f"all_{c}") for c in sums])
    inside = Window.partitionBy(*key, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = joined(cut, offsets, [*key, "_part"])
    return out.withColumns({f"below_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) + F.col(f"_b_{c}") for c in sums}).drop("_part", "_one", *[f"_b_{c}" for c in sums])


def least_ahead(rows: DataFrame, value: str, of: str, name: str, by: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Adds name: the least `of` over the rows of the group whose value is not smaller.

    rows: one row for each group and value; ranges as in running_sums, taken from the largest value down, since
    a frame that ends at the last row is worked out anew for each row.
    """
    by = list(by or [])
    named = rows if by else rows.withColumn("_one", F.lit(0))
    key = by or ["_one"]
    parts = parts or parts_for(rows, by)
    down = lambda *more: Window.partitionBy(*key, *more)
    if parts == 1:
        return named.withColumn(name, F.min(of).over(down().orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0))).drop("_one")
    cut = _cut(named, value, key, parts)
    after = cut.groupBy(*key, "_part").agg(F.min(of).alias("_m")).select(*key, "_part", F.min("_m").over(down().orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)).alias("_after"))
    own = F.min(of).over(down("_part").orderBy(F.col(value).desc()).rowsBetween(Window.unboundedPreceding, 0))
    return joined(cut, after, [*key, "_part"]).withColumn(name, F.least(own, "_after")).drop("_part", "_one", "_after")


def ordered_bits(value: Column) -> Column:
    """The bits of doubles as longs that have their order (-0.0 as 0.0, NaN last)."""

    @F.pandas_udf("long")
    def bits(v: pd.Series) -> pd.Series:
        x = v.to_numpy(np.float64) + 0.0
        return pd.Series(_flipped(np.where(np.isnan(x), np.nan, x).view(np.int64)))

    return bits(value)


def from_ordered_bits(bits: Column) -> Column:
    @F.pandas_udf("double")
    def value(b: pd.Series) -> pd.Series:
        return pd.Series(_flipped(b.to_numpy(np.int64)).view(np.float64))

    return value(bits)


def _flipped(b: np.ndarray) -> np.ndarray:
    return b ^ (b >> 63 & np.int64((1 << 63) - 1))


def order_statistics(bits: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """by, _rank, _v: the values of the wanted (by, _rank from 0) among (by, _bits), by radix selection.

    Each of four passes counts the next 16 bits of what agrees with a wanted value so far, so a group and
    value never take more than 65,536 counts, however many rows or different values there are.
    """
    found = wanted.select(*by, "_rank", F.lit(0).cast("long").alias("_below"), F.lit(0).cast("long").alias("_prefix"))
    for shift in (48, 32, 16, 0):
        digits = bits.select(*by, F.shiftright("_bits", shift).alias("_next"))
        if shift < 48:
            digits = joined(digits.withColumn("_prefix", F.shiftright("_next", 16)), found.select(*by, "_prefix").distinct(), [*by, "_prefix"])
        else:
            digits = digits.withColumn("_prefix", F.lit(0).cast("long"))
        counts = digits.groupBy(*by, "_prefix", "_next").agg(F.count("*").alias("_c"))
        along = Window.partitionBy(*by, "_prefix").orderBy("_next")
        counts = counts.withColumn("_upto", F.sum("_c").over(along))
        place = joined(found, counts, [*by, "_prefix"])
        at = F.col("_rank") - F.col("_below")
        hit = place.where((at < F.col("_upto")) & (at >= F.col("_upto") - F.col("_c")))
        found = hit.select(*by, "_rank", (F.col("_below") + F.col("_upto") - F.col("_c")).alias("_below"), F.col("_next").alias("_prefix"))
        if shift:
            path = folder(bits.sparkSession, "ranks")
            found.write.parquet(path)
            found = bits.sparkSession.read.schema(found.schema).parquet(path)
    return found.select(*by, "_rank", from_ordered_bits(F.col("_prefix")).alias("_v"))


def exact_percentiles(df: DataFrame, value: Column, shares: list[float], by: list[str] | None = None, held: int = HELD) -> DataFrame:
    """by, and q: the exact percentiles at shares, on the line between neighbours; nulls don't count.  Groups without values have no row.

    Groups of up to `held` values are aggregated as they are. The values of larger ones are found by
    radix selection (order_statistics) in the order of their bits, which are written once.
    """
    by = list(by or [])
    v = df.select(*by, value.cast("double").alias("_v")).where("_v is not null")
    sizes = v.groupBy(*by).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    plain = lambda rows: rows.groupBy(*by).agg(F.percentile("_v", F.array(*[F.lit(float(s)) for s in shares])).alias("q")).where("q is not null")
    if most <= held:
        return plain(v)
    large = sizes.where(F.col("_n") > held).withColumn("_large", F.lit(True))
    if by:
        known = large.withColumnsRenamed({c: f"_r_{c}" for c in by}).drop("_n")
        same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_r_{c}")) for c in by])
        told = v.join(known, same, "left").drop(*[f"_r_{c}" for c in by])
    else:
        told = v.withColumn("_large", F.lit(True))
    path = folder(df.sparkSession, "bits")
    told.where("_large").select(*by, ordered_bits(F.col("_v")).alias("_bits")).write.parquet(path)
    bits = df.sparkSession.read.schema(told.select(*by, F.lit(0).cast("long").alias("_bits")).schema).parquet(path)
    at = lambda s: (F.col("_n") - 1) * F.lit(float(s))
    ends = F.array_distinct(F.array(*[f(at(s)).cast("long") for s in shares for f in (F.floor, F.ceil)]))
    values = order_statistics(bits, large.select(*by, F.explode(ends).alias("_rank")), by)
    maps = values.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_m"))
    row = joined(large, maps, by) if by else large.crossJoin(F.broadcast(maps))
    part = lambda s: at(s) - F.floor(at(s))
    end = lambda s, f: F.element_at("_m", f(at(s)).cast("long"))
    q = F.array(*[F.when(part(s) == 0, end(s, F.floor)).otherwise(end(s, F.floor) * (1 - part(s)) + end(s, F.ceil) * part(s)) for s in shares])
    out = row.select(*by, q.alias("q"))
    return out.unionByName(plain(told.where("_large is null"))) if by else out


def hash_rank(df: DataFrame, key: str, salt: Column, by: list[str], name: str) -> DataFrame:
    """Adds each row's place (from 0) in its group's order by md5(key:salt), then key; 256 ranges of the hash a group."""
    hashed = df.withColumn("_h", F.md5(F.concat_ws(":", F.col(key).cast("string"), salt.cast("string")).cast("binary"))).withColumn("_part", F.substring("_h", 1, 2))
    sizes = hashed.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*by, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_part").orderBy("_h", key)
    return joined(hashed, offsets, [*by, "_part"]).withColumn(name, F.col("_before") + F.row_number().over(inside) - 1).drop("_h", "_part", "_before")
