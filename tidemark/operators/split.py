"""Cohort splits that keep strata exact and never divide a subject."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.ranged import exact_percentiles, hash_rank


def tertiles(df: DataFrame, value: str, name: str, q: int = 3) -> DataFrame:
    """Bins 0..q-1 at exact quantiles, closed on the right, the lowest value included."""
    return tertiles_of(df, {value: name}, q)


def tertiles_of(df: DataFrame, names: dict[str, str], q: int = 3) -> DataFrame:
    """The same for several columns (column: name of its bins), whose quantiles are found together."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), F.col(v).cast("double").alias("_v")) for v, n in names.items()])).alias("e")).select("e.*")
    cuts = exact_percentiles(long, F.col("_v"), [k / q for k in range(1, q)], ["_name"])
    row = cuts.agg(*[F.first(F.when(F.col("_name") == n, F.col("q")), ignorenulls=True).alias(f"_q_{n}") for n in names.values()])
    above = lambda v, n: F.size(F.filter(f"_q_{n}", lambda c: F.col(v) > c + 1e-9 * F.abs(c)))
    joined = df.join(F.broadcast(row))
    return joined.withColumns({n: F.when(F.col(v).isNotNull(), above(v, n)) for v, n in names.items()}).drop(*[f"_q_{n}" for n in names.values()])


def stratum(columns: list[str]):
    return F.concat_ws("", *[F.col(c).cast("string") for c in columns])


def stratified_split(df: DataFrame, key: str, stratum_col: str, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds split: `train` for exactly round(fraction * n) subjects, each stratum as near its share as whole subjects allow.

    Strata get the floor of their share; the largest remainders get one more until the total is exact.
    Ranks follow md5 of key and seed, in ranges of the hash; the top-up runs on one row a stratum.
    """
    ranked = hash_rank(df, key, F.lit(seed), [stratum_col], "_rank").withColumn("_rank", F.col("_rank") + 1)
    sizes = df.groupBy(stratum_col).agg(F.count("*").alias("_n")).withColumn("_share", F.col("_n") * fraction)
    total = Window.partitionBy(F.lit(0))
    sizes = sizes.withColumn("_base", F.floor("_share")).withColumn("_want", F.round(F.sum("_n").over(total) * fraction) - F.sum("_base").over(total))
    order = total.orderBy(F.round(F.col("_share") - F.col("_base"), 9).desc(), stratum_col)  # equal shares tie
    sizes = sizes.withColumn("_take", F.col("_base") + (F.row_number().over(order) <= F.col("_want")).cast("int")).select(stratum_col, "_take")
    return ranked.join(F.broadcast(sizes), stratum_col).withColumn("split", F.when(F.col("_rank") <= F.col("_take"), "train").otherwise("test")).drop("_rank", "_take")


def group_kfold(df: DataFrame, label: str, group: str, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """group, repeat, fold: each group in one fold a repeat, label shares as even as the groups allow.

    Groups are ranked within bands of like size and label share, shuffled by a seeded hash, and dealt to
    folds in snake order; ranks and the first fold of a band follow md5, in ranges of the hash.
    """
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.avg(F.col(label).cast("double")).alias("rate"))
    per = per.withColumn("_band", F.floor(F.log2(F.col("n"))) * 100 + F.floor(F.coalesce("rate", F.lit(0.0)) * 10))
    rep = per.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    first = F.md5(F.concat_ws(":", F.col("_band").cast("string"), (F.col("repeat") + seed).cast("string")).cast("binary"))
    ranked = hash_rank(rep.withColumn("_band", F.col("_band").cast("long")), group, F.col("repeat") + seed, ["repeat", "_band"], "_place")
    dealt = ranked.withColumn("_r", F.col("_place") + F.conv(F.substring(first, 1, 8), 16, 10).cast("long") % k)
    turn, at = F.floor(F.col("_r") / k), F.col("_r") % k
    return dealt.select(group, "repeat", F.when(turn % 2 == 0, at).otherwise(k - 1 - at).cast("int").alias("fold"), "n", "rate")


def hash_sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows without replacement, the same for the same keys and seed."""
    return df.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed))).cast("binary")), key).limit(n)


def group_subsample(df: DataFrame, label: str, group: str, about: int, rows: int, seed: int = 42) -> DataFrame:
    """Whole groups of about so many rows: one of rows // about folds."""
    folds = max(1, rows // about)
    keep = group_kfold(df, label, group, folds, 1, seed).where("fold = 0").select(group)
    return df.join(keep, group, "left_semi")


#: Sizes up to this are told apart exactly when groups are allotted to folds; larger ones to about 1 / FINE of them.
EXACT_SIZE, FINE = 64, 16


def _kind(n: str) -> Column:
    """A number as it is up to EXACT_SIZE, beyond as the foot of its step on a scale of FINE steps an octave."""
    c = F.col(n)
    steps = F.floor(F.log2(F.greatest(c, F.lit(1)).cast("double")) * FINE)
    return F.when(c <= EXACT_SIZE, c.cast("long")).otherwise(EXACT_SIZE + steps).cast("long")


def _allot(kinds: list[tuple], k: int, seed: int) -> list[tuple]:
    """(kind, folds of its groups beyond equal shares): each goes where the labels' shares come out most even.

    kinds: (size kind, positives kind, groups, mean size, mean positives). Equal numbers of each kind's groups go
    to every fold beforehand. Kinds follow by how uneven their labels are; ties of folds go to the one with fewest rows.
    """
    rng = random.Random(seed)
    totals = np.maximum(np.sum([[(n - p) * g, p * g] for _, _, g, n, p in kinds], axis=0), 1e-300)
    folds = np.sum([np.tile([(n - p) * (g // k), p * (g // k)], (k, 1)) for _, _, g, n, p in kinds], axis=0)
    out = []
    order = [(kind, [n - p, p]) for kind in kinds for _, _, g, n, p in [kind] for _ in range(g % k)]
    rng.shuffle(order)
    order.sort(key=lambda o: -np.std(o[1]))
    taken: dict[tuple, list[int]] = {}
    for kind, counts in order:
        tried = np.tile(folds, (k, 1, 1))
        tried[np.arange(k), np.arange(k)] += counts
        uneven = np.round((tried / totals).std(axis=1).mean(axis=1), 12)
        best = min(range(k), key=lambda f: (uneven[f], folds[f].sum()))
        folds[best] += counts
        taken.setdefault(kind[:2], []).append(best)
    for kind in kinds:
        out.append((kind[0], kind[1], int(kind[2]), taken.get(kind[:2], [])))
    return out


def balanced_group_kfold(df: DataFrame, label: str, group: str, k: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """group, repeat, fold, n, positives: each group in one fold a repeat, so that folds have like shares of both labels.

    Groups are counted by kind, their numbers of rows and of positives (large numbers in small steps, so there are
    never more than some 100,000 kinds, which the driver holds). Each kind's groups go to all folds in equal
    numbers; the fewer than k left over of each are allotted one by one, those with the most uneven labels first,
    to the fold where the labels' shares over folds come out most even. A group's place within its kind
    follows a seeded hash. Null labels count as 0; a null group is a group.
    """
    per = df.groupBy(group).agg(F.count("*").alias("n"), F.count_if(F.col(label) == 1).alias("positives"))
    per = per.withColumns({"_a": _kind("n"), "_b": _kind("positives")})
    kinds = [tuple(r) for r in per.groupBy("_a", "_b").agg(F.count("*"), F.avg("n"), F.avg("positives")).orderBy("_a", "_b").collect()]
    if not kinds:
        return per.select(group, F.lit(0).alias("repeat"), F.lit(0).alias("fold"), "n", "positives")
    rows = [(r, *kind) for r in range(repeats) for kind in _allot(kinds, k, seed + r)]
    allotted = df.sparkSession.createDataFrame(rows, "repeat int, _a long, _b long, _g long, _left array<int>")
    rep = per.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    ranked = hash_rank(rep, group, F.col("repeat") + seed, ["repeat", "_a", "_b"], "_place")
    placed = ranked.join(F.broadcast(allotted), ["repeat", "_a", "_b"])
    even = F.col("_g") - F.col("_g") % k
    fold = F.when(F.col("_place") < even, F.col("_place") % k).otherwise(F.get("_left", (F.col("_place") - even).cast("int")))
    return placed.select(group, "repeat", fold.cast("int").alias("fold"), "n", "positives")


def balanced_group_subsample(df: DataFrame, label: str, group: str, about: int, rows: int, seed: int = 42) -> DataFrame:
    """Whole groups of about so many rows with the labels' shares of all: one of rows // about balanced folds."""
    keep = balanced_group_kfold(df, label, group, max(1, rows // about), 1, seed).where("fold = 0").select(F.col(group).alias("_keep"))
    return df.join(keep, F.col(group).eqNullSafe(F.col("_keep")), "left_semi")
