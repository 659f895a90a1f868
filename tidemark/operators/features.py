"""Window vectors: alignment, downsampling, scaling, projection, design features, selection."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import array_mean, array_std
from tidemark.functions.ranged import exact_percentiles, joined, parts_for, running_sums
from tidemark.operators.pca import by_variance as pca_by_variance  # noqa: F401
from tidemark.sources.scratch import folder


def align_variables(vectors: DataFrame, variables: list[str], keys: list[str]) -> DataFrame:
    """One row for each key that has all variables, with one array column a variable: a single shuffle."""
    wide = vectors.where(F.col("variable").isin(variables)).groupBy(*keys).agg(*[F.first(F.when(F.col("variable") == v, F.col("x")), ignorenulls=True).alias(v) for v in variables])
    return wide.dropna(subset=variables)


def concat_vectors(aligned: DataFrame, variables: list[str], name: str = "x") -> DataFrame:
    return aligned.withColumn(name, F.concat(*variables))


def channels(x: str, n: int, length: int) -> Column:
    """A flat array as n channels of `length` steps."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda c: F.slice(F.col(x), c * length + 1, F.lit(length)))


def downsample(x: str, factor: int | Column, how: str = "mean") -> Column:
    """Mean or median of each `factor` steps; a shorter rest goes."""
    factor = F.lit(factor) if isinstance(factor, int) else factor
    at = F.sequence(F.lit(0), F.floor(F.size(x) / factor).cast("int") - 1)
    part = lambda i: F.slice(F.col(x), i * factor + 1, factor)
    if how == "mean":
        value = lambda i: array_mean(part(i))
    else:
        value = lambda i: (F.get(F.sort_array(part(i)), F.floor((factor - 1) / 2).cast("int")) + F.get(F.sort_array(part(i)), F.floor(factor / 2).cast("int"))) / 2
    return F.when(F.size(x) >= factor, F.transform(at, value)).otherwise(F.array().cast("array<double>"))


def common_grid(vectors: DataFrame, how: str = "mean", frequency: int = 60, x: str = "x", variable: str = "variable", by: str = "split") -> DataFrame:
    """All variables of a split brought to its shortest one's length, then to `frequency` points a minute (of 60).

    A variable's windows are equally long; one row a split and variable says by which factor they shrink.
    """
    sizes = vectors.groupBy(by, variable).agg(F.max(F.size(x)).alias("_size"))
    least = sizes.groupBy(by).agg(F.min("_size").alias("_least"))
    factors = joined(sizes, least, [by]).select(by, variable, F.floor(F.col("_size") / F.col("_least")).cast("int").alias("_factor"))
    out = joined(vectors, factors, [by, variable]).withColumn(x, downsample(x, F.col("_factor"), how)).drop("_factor")
    return out.withColumn(x, downsample(x, 60 // frequency, how)) if frequency < 60 else out


def fit_scaler(train: DataFrame, kind: str = "robust", by: str = "variable", x: str = "x", accuracy: int | None = None) -> DataFrame:
    """by, centre, scale: one for each variable over all its windows and steps.

    robust: median and the distance from the 10th to the 90th percentile (exact; with `accuracy`
    approximate, in bounded memory); standard: mean and population deviation; minmax: least value and range.
    """
    v = train.select(by, F.explode(F.col(x).cast("array<double>")).alias("v"))
    if kind == "robust" and not accuracy:
        return exact_percentiles(v, F.col("v"), [0.1, 0.5, 0.9], [by]).select(by, F.col("q")[1].alias("centre"), (F.col("q")[2] - F.col("q")[0]).alias("scale"))
    if kind == "robust":
        p = lambda q: F.percentile_approx("v", F.lit(q), F.lit(accuracy))
        centre, scale = p(0.5), p(0.9) - p(0.1)
    elif kind == "standard":
        centre, scale = F.avg("v"), F.stddev_pop("v")
    elif kind == "minmax":
        centre, scale = F.min("v"), F.max("v") - F.min("v")
    else:
        raise ValueError(f"no such scaler: {kind}")
    return v.groupBy(by).agg(centre.alias("centre"), scale.alias("scale"))


def apply_scaler(df: DataFrame, params: DataFrame, by: str = "variable", x: str = "x", flip: tuple[str, ...] = ()) -> DataFrame:
    """(v - centre) / scale of every step (100 - v for variables in flip, before scaling); one parameter row a variable."""
    joined = df.join(F.broadcast(params), by)
    raw = lambda v: F.when(F.col(by).isin(list(flip)), 100 - v).otherwise(v) if flip else v
    scaled = F.transform(x, lambda v: F.try_divide(raw(v.cast("double")) - F.col("centre"), F.col("scale")))
    return joined.withColumn(x, scaled).drop("centre", "scale")


def flip_tail(x: str, top: float = 100.0) -> Column:
    return F.transform(x, lambda v: top - v)


def yeo_johnson(v: Column, lam: float) -> Column:
    up = (F.pow(v + 1, F.lit(lam)) - 1) / lam if abs(lam) > 1e-12 else F.log1p(v)
    down = -(F.pow(1 - v, F.lit(2 - lam)) - 1) / (2 - lam) if abs(2 - lam) > 1e-12 else -F.log1p(-v)
    return F.when(v >= 0, up).otherwise(down)


def fit_power(train: DataFrame, value: str, lo: float = -2.0, hi: float = 4.0, steps: int = 13, rounds: int = 3) -> float:
    """The Yeo-Johnson exponent with the highest likelihood: a grid in one aggregate, refined around the best."""
    v = F.col(value).cast("double")
    sign = F.sum(F.signum(v) * F.log1p(F.abs(v)))
    for _ in range(rounds):
        grid = [lo + (hi - lo) * k / (steps - 1) for k in range(steps)]
        row = train.agg(sign.alias("s"), F.count(v).alias("n"), *[F.var_pop(yeo_johnson(v, g)).alias(f"v{k}") for k, g in enumerate(grid)]).first()
        score = [-row["n"] / 2 * np.log(max(row[f"v{k}"] or 0, 1e-300)) + (g - 1) * (row["s"] or 0) for k, g in enumerate(grid)]
        best = int(np.argmax(score))
        lo, hi = grid[max(0, best - 1)], grid[min(steps - 1, best + 1)]
    return grid[best]


def power_transform(df: DataFrame, value: str, lam: float, name: str) -> DataFrame:
    """Transformed and standardized over all rows."""
    t = df.withColumn("_t", yeo_johnson(F.col(value).cast("double"), lam))
    s = t.agg(F.avg("_t").alias("_m"), F.stddev_pop("_t").alias("_s"))
    return t.join(F.broadcast(s)).withColumn(name, F.try_divide(F.col("_t") - F.col("_m"), F.col("_s"))).drop("_t", "_m", "_s")


def lag_list(length: int, step: int) -> list[int]:
    """Multiples of step below the length in size, without the highest when it would be the last sample's."""
    lags = list(range(-((length - 1) // step) * step, length - 1, step))
    return [l for l in lags if l > -length and l + step < length or l <= 0 and l > -length]


def centred(df: DataFrame, names: list[str]) -> DataFrame:
    """Array columns' values less their mean, over their deviation (null where that is 0); each worked out once."""
    stats = df.withColumns({f"_m_{n}": array_mean(n) for n in names} | {f"_s_{n}": array_std(n) for n in names})
    scaled = lambda n: F.transform(n, lambda v: F.try_divide(v - F.col(f"_m_{n}"), F.col(f"_s_{n}")))
    out = stats.withColumns({n: scaled(n) for n in names})
    return out.drop(*[f"_m_{n}" for n in names], *[f"_s_{n}" for n in names])


def lagged_dot(x: Column, y: Column, length: int, lag: int) -> Column:
    """The lagged correlation of two centred() arrays; 0 where undefined."""
    a, b = (F.slice(x, lag + 1, length - lag), F.slice(y, 1, length - lag)) if lag >= 0 else (F.slice(x, 1, length + lag), F.slice(y, 1 - lag, length + lag))
    return F.coalesce(F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v) / length, F.lit(0.0))


def lagged_correlations(x: Column, y: Column, lags: list[int]) -> Column:
    """lagged_correlation of two arrays at all lags, as an array, from one zero-padded Fourier transform a batch of rows.

    Rows whose arrays differ in length, and lags beyond it, give 0 like undefined ones; null arrays give null.
    """

    @F.arrow_udf("array<double>")
    def work(a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros((len(a), len(lags)))
        given = np.logical_and(*(c.is_valid().to_numpy(zero_copy_only=False) for c in (a, b)))
        size, other = (np.where(given, c.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), 0) for c in (a, b))
        for length in np.unique(size[(size == other) & (size > 0)]):
            rows = np.flatnonzero(given & (size == length) & (other == length))
            wide = 1 << int(2 * length - 1).bit_length()
            some = max(1, (1 << 21) // wide)
            near = np.array([k for k, lag in enumerate(lags) if abs(lag) < length], int)
            for i in range(0, len(rows), some):
                part = rows[i : i + some]
                p, q = (c.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False).reshape(len(part), length) for c in (a, b))
                p, q = p - p.mean(1, keepdims=True), q - q.mean(1, keepdims=True)
                scale = np.sqrt((p * p).mean(1) * (q * q).mean(1)) * length
                both = np.fft.irfft(np.fft.rfft(p, wide) * np.conj(np.fft.rfft(q, wide)), wide)
                found = both[:, [lags[k] % wide for k in near]] / np.where(scale > 0, scale, 1)[:, None]
                out[np.ix_(part, near)] = np.where(scale[:, None] > 0, np.nan_to_num(found), 0)
        offsets = pa.array(np.arange(len(a) + 1) * len(lags), pa.int32(), mask=np.append(~given, False))
        return pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))

    return work(x.cast("array<double>"), y.cast("array<double>"))


def lagged_correlation(x: Column, y: Column, length: int, lag: int) -> Column:
    """sum over n of (x[n + lag] - mean x)(y[n] - mean y) / (std x * std y * length); 0 where undefined."""
    a, b = (F.slice(x, lag + 1, length - lag), F.slice(y, 1, length - lag)) if lag >= 0 else (F.slice(x, 1, length + lag), F.slice(y, 1 - lag, length + lag))
    mx, my = array_mean(x), array_mean(y)
    dot = F.aggregate(F.zip_with(a, b, lambda p, q: (p - mx) * (q - my)), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(dot, array_std(x) * array_std(y) * length), F.lit(0.0))


def difference(x: Column) -> Column:
    """First differences along time."""
    return F.zip_with(F.slice(x, F.lit(2), F.greatest(F.size(x) - 1, F.lit(0))), F.slice(x, F.lit(1), F.greatest(F.size(x) - 1, F.lit(0))), lambda a, b: a - b)


def design_features(df: DataFrame, names: list[str], length: int, x: str = "x", ref: str = "abp", pair: tuple[str, str] | None = None, step: int = 60, whiten: bool = False) -> DataFrame:
    """Adds features: means, deviations, and the reference channel's lagged correlations with each other one.

    pair adds the difference of two channels as one more channel.
    """
    parts = {n: F.slice(F.col(x), i * length + 1, length).cast("array<double>") for i, n in enumerate(names)}
    if pair:
        parts["asymmetry"] = F.zip_with(parts[pair[0]], parts[pair[1]], lambda a, b: a - b)
    named = df.withColumns({f"_{n}": p for n, p in parts.items()})
    cols = {n: F.col(f"_{n}") for n in parts}
    means, stds = [array_mean(c) for c in cols.values()], [array_std(c) for c in cols.values()]
    size = length
    if whiten:
        named = named.withColumn("_moments", F.array(*means, *stds)).withColumns({f"_{n}": difference(c) for n, c in cols.items()})
        size -= 1
    lags = lag_list(size, step)
    moments = named.withColumn("_moments", F.array(*means, *stds)) if not whiten else named
    corr = [lagged_dot(cols[ref], c, size, lag) for n, c in cols.items() if n != ref for lag in lags]
    return centred(moments, list(f"_{n}" for n in cols)).withColumn("features", F.concat("_moments", F.array(*corr))).drop("_moments").drop(*[f"_{n}" for n in parts])


def mutual_information(df: DataFrame, label: str, x: str = "x", bins: int = 10) -> DataFrame:
    """feature, mi: mutual information in nats of each feature, cut into equal-frequency bins, with the class.

    Bin edges are exact percentiles of each feature; one row a feature, sent to all tasks.
    """
    long = df.select(F.col(label).alias("y"), F.posexplode(x).alias("feature", "v"))
    edges = exact_percentiles(long, F.col("v"), [k / bins for k in range(1, bins)], ["feature"]).withColumnRenamed("q", "edges")
    binned = long.join(F.broadcast(edges), "feature").withColumn("bin", F.size(F.filter("edges", lambda e: F.col("v") > e)))
    joint = binned.groupBy("feature", "bin", "y").agg(F.count("*").alias("c"))
    n = F.sum("c").over(Window.partitionBy("feature"))
    nx = F.sum("c").over(Window.partitionBy("feature", "bin"))
    ny = F.sum("c").over(Window.partitionBy("feature", "y"))
    terms = joint.select("feature", (F.col("c") / n * F.ln(F.col("c") * n / (nx * ny))).alias("t"))
    return terms.groupBy("feature").agg(F.sum("t").alias("mi"))


def digamma(n: Column) -> Column:
    """The digamma function of positive integers: its asymptotic series, ten steps further up."""
    m = n.cast("double") + 10
    series = F.ln(m) - 1 / (2 * m) - 1 / (12 * m * m) + 1 / (120 * F.pow(m, F.lit(4.0))) - 1 / (252 * F.pow(m, F.lit(6.0))) + 1 / (240 * F.pow(m, F.lit(8.0)))
    return series - reduce(lambda a, b: a + b, [1 / (n.cast("double") + i) for i in range(10)])


def mutual_information_near(df: DataFrame, label: str, x: str = "x", k: int = 3, parts: int | None = None) -> DataFrame:
    """feature, mi: mutual information in nats of each feature with the class, estimated from nearest neighbours.

    For each row the distance r to its k-th nearest value of the same class and feature (fewer in smaller classes, rows
    of classes of one don't count) and the number m of values of all classes nearer than r (at r = 0: equal
    ones) give digamma(n) + mean digamma(k) - mean digamma(class size) - mean digamma(m), 0 at least.

    A feature's values are cut into ranges at approximate quantiles. Each range is sorted on its own, with
    the k nearest values of each class before and after it; m is a difference of two ranks, which
    running sums over the ranges give. So no task orders a whole feature. Null values and labels don't count.
    """
    long = df.select(F.col(label).alias("y"), F.posexplode(x).alias("feature", "v")).select("feature", "y", F.col("v").cast("double").alias("v")).where("v is not null and y is not null")
    sizes = long.groupBy("feature", "y").agg(F.count("*").alias("size")).where("size > 1")
    parts = parts or parts_for(long, ["feature"])
    cuts = F.percentile_approx("v", F.array(*[F.lit(i / parts) for i in range(1, parts)]), F.lit(max(1000, 8 * parts))) if parts > 1 else F.array().cast("array<double>")
    cuts = long.groupBy("feature").agg(F.count("*").alias("_n"), cuts.alias("_cuts")).drop("_n")  # a row a feature
    known = long.join(sizes, ["feature", "y"]).join(F.broadcast(cuts), "feature").withColumn("_part", F.size(F.filter("_cuts", lambda c: F.col("v") > c))).drop("_cuts")
    path = folder(df.sparkSession, "near")
    known.write.parquet(path)
    known = df.sparkSession.read.schema(known.schema).parquet(path)
    halo = []
    for after in (False, True):
        end = Window.partitionBy("feature", "y", "_part").orderBy(F.col("v") if after else F.col("v").desc())
        ends = known.withColumn("_i", F.row_number().over(end)).where(F.col("_i") <= k).groupBy("feature", "y", "_part").agg(F.sort_array(F.collect_list("v"), asc=after).alias("_e"))
        along = Window.partitionBy("feature", "y").orderBy(F.col("_part").desc() if after else F.col("_part")).rowsBetween(Window.unboundedPreceding, -1)
        near = ends.withColumn("_e", F.slice(F.flatten(F.reverse(F.collect_list("_e").over(along))), 1, k))  # k values a range, nearest first
        halo.append(near.select("feature", "y", F.explode("_e").alias("v"), F.lit(None).cast("long").alias("size"), "_part"))
    both = known.unionByName(halo[0]).unionByName(halo[1])
    w = Window.partitionBy("feature", "y", "_part").orderBy("v")
    apart = lambda other: F.struct(F.abs(other - F.col("v")).alias("d"), other.alias("w"))
    around = F.array(*[apart(f("v", i).over(w)) for f in (F.lag, F.lead) for i in range(1, k + 1)])
    sorted_ = both.withColumn("_d", F.array_sort(F.filter(around, lambda d: d["d"].isNotNull()))).where("size is not null")
    order = F.least(F.lit(k), F.col("size") - 1).cast("int")
    found = sorted_.withColumns({"_k": order, "_e": F.element_at("_d", order)}).select("feature", "v", "size", "_k", F.col("_e.d").alias("_r"), F.col("_e.w").alias("_w"))
    # m: ranks of both ends of the open interval (closed where it is a point), from one running sum over values and ends
    # the k-th neighbour is one of the ends as it is, since v + (w - v) may differ from w
    low, high = F.when(F.col("_w") <= F.col("v"), F.col("_w")).otherwise(F.col("v") - F.col("_r")), F.when(F.col("_w") >= F.col("v"), F.col("_w")).otherwise(F.col("v") + F.col("_r"))
    ends = F.array(F.struct(low.alias("at"), F.lit(-1).alias("sign"), (F.col("_r") > 0).alias("upto")), F.struct(high.alias("at"), F.lit(1).alias("sign"), (F.col("_r") == 0).alias("upto")))
    asked = found.withColumn("_id", F.monotonically_increasing_id())
    path = folder(df.sparkSession, "asked")
    asked.write.parquet(path)
    asked = df.sparkSession.read.schema(asked.schema).parquet(path)
    points = asked.select("feature", "_id", F.explode(ends).alias("e")).select("feature", "_id", "e.*")
    values = known.groupBy("feature", "v").agg(F.count("*").alias("_c"))
    counts = values.select("feature", F.col("v").alias("at"), "_c").unionByName(points.select("feature", "at", F.lit(0).cast("long").alias("_c")).distinct()).groupBy("feature", "at").agg(F.sum("_c").alias("_c"))
    ranks = running_sums(counts, "at", ["_c"], ["feature"], parts).select("feature", "at", "below__c", "_c")
    placed = points.join(ranks, ["feature", "at"])
    m = placed.groupBy("_id").agg(F.sum(F.col("sign") * (F.col("below__c") + F.when(F.col("upto"), F.col("_c")).otherwise(0))).alias("_m"))
    told = asked.join(m, "_id")
    n = F.count("*")
    mi = digamma(n) + F.avg(digamma(F.col("_k"))) - F.avg(digamma(F.col("size"))) - F.avg(digamma(F.col("_m")))
    return told.groupBy("feature").agg(F.greatest(F.lit(0.0), mi).alias("mi"))


def select_top(scores: DataFrame, percentile: float, score: str = "mi") -> DataFrame:
    """Adds selected: the features whose score lies above the (100 - percentile)th percentile; of those at it,
    the first ones that fit into percentile percent of all. One row a feature."""
    cut = scores.agg(F.percentile(score, F.lit(1 - percentile / 100)).alias("_cut"), F.count("*").alias("_n"))
    d = scores.join(F.broadcast(cut))
    above = F.sum((F.col(score) > F.col("_cut")).cast("int")).over(Window.partitionBy(F.lit(0)))
    tie = F.row_number().over(Window.partitionBy(F.col(score) == F.col("_cut")).orderBy("feature"))
    room = F.floor(F.col("_n") * percentile / 100) - above
    return d.withColumn("selected", (F.col(score) > F.col("_cut")) | ((F.col(score) == F.col("_cut")) & (tie <= room))).drop("_cut", "_n")


def keep_features(df: DataFrame, selected: DataFrame, x: str = "x") -> DataFrame:
    """x cut down to the selected features, in their order; the list (a number a feature) goes along in one row."""
    wanted = selected.where("selected").agg(F.sort_array(F.collect_list(F.col("feature").cast("int"))).alias("_wanted"))
    return df.join(F.broadcast(wanted)).withColumn(x, F.transform("_wanted", lambda i: F.get(x, i))).drop("_wanted")


def convolution_kernels(length: int, n: int, seed: int = 42) -> list[tuple[np.ndarray, float, int]]:
    """Seeded random kernels: centred weights, bias and dilation."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(n):
        size = int(rng.choice([7, 9, 11]))
        size = min(size, length)
        w = rng.normal(size=size)
        most = max(0.0, np.log2((length - 1) / max(1, size - 1)))
        out.append((w - w.mean(), float(rng.uniform(-1, 1)), int(2 ** rng.uniform(0, most))))
    return out


def convolution_features(df: DataFrame, x: str = "x", n_kernels: int = 100, seed: int = 42, name: str = "features") -> DataFrame:
    """Share of positive values and maximum of each random convolution of each window, batch by batch."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(T.DoubleType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(batch.schema.get_field_index(x)).to_pylist()
            out: list = [None] * len(rows)
            by_length: dict[int, list[int]] = {}
            for i, r in enumerate(rows):
                if r is not None and len(r) > 2 and None not in r:
                    by_length.setdefault(len(r), []).append(i)
            for length, index in by_length.items():
                m = np.array([rows[i] for i in index], float)
                sd = m.std(1, keepdims=True)
                m = (m - m.mean(1, keepdims=True)) / np.where(sd > 0, sd, 1)
                found = []
                for w, b, dilation in convolution_kernels(length, n_kernels, seed):
                    span = (len(w) - 1) * dilation
                    conv = sum(w[k] * m[:, k * dilation : length - span + k * dilation] for k in range(len(w))) + b
                    found += [(conv > 0).mean(1), conv.max(1)]
                for i, f in zip(index, np.stack(found, 1)):
                    out[i] = f.tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.float64()))], [*batch.schema.names, name])

    return df.mapInArrow(work, schema)
