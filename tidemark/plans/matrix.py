"""Queries over window vectors: alignment, scaling, projection, features, models."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.operators import features as fe
from tidemark.operators import models, split
from tidemark.sources import tables as t
from tidemark.sources.tables import sql

QUERIES: dict = {}
ORACLES: dict = {}
R = lambda c, n=6: F.round(c, n)
CHANNELS, STEPS = ["abp", "hr", "left", "right"], 16


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def _total(x):
    return F.aggregate(x, F.lit(0.0), lambda s, v: s + v)


@query(sql("signal", """v as (select subject_id, ts_us // 86400000000 as day, variable, avg(value) as m, count(*) as n from signal where variable in ('view', 'click', 'purchase') group by all)
select subject_id, day, round(a.m, 6) as "view", round(b.m, 6) as click, round(c.m, 6) as purchase from v a join v b using (subject_id, day) join v c using (subject_id, day) where a.variable = 'view' and b.variable = 'click' and c.variable = 'purchase'"""))
def align_variables(spark, d):
    v = t.daily(spark, d, by_variable=True).select("subject_id", "day", "variable", F.array("mean").alias("x"))
    a = fe.align_variables(v, ["view", "click", "purchase"], ["subject_id", "day"])
    return a.select("subject_id", "day", *[R(F.col(c)[0]).alias(c) for c in ("view", "click", "purchase")])


@query(sql("signal", """v as (select subject_id, ts_us // 86400000000 as day, variable, list(value order by ts_us, value) as x from signal where variable in ('view', 'click') group by all)
select subject_id, day, len(list_concat(a.x, b.x)) as n, round(a.x[1], 6) as head, round(b.x[-1], 6) as tail from v a join v b using (subject_id, day) where a.variable = 'view' and b.variable = 'click'"""))
def concat_vectors(spark, d):
    s = t.signal(spark, d).where("variable in ('view', 'click')").withColumn("day", F.floor(F.col("ts_us") / 86400000000))
    v = s.groupBy("subject_id", "day", "variable").agg(F.transform(F.sort_array(F.collect_list(F.struct("ts_us", "value"))), lambda e: e["value"]).alias("x"))
    c = fe.concat_vectors(fe.align_variables(v, ["view", "click"], ["subject_id", "day"]), ["view", "click"])
    return c.select("subject_id", "day", F.size("x").cast("long").alias("n"), R(F.col("x")[0]).alias("head"), R(F.element_at("x", -1)).alias("tail"))


@query(sql("vectors", "select id, unnest(range(4)) as channel, round(x[unnest(range(4)) * 16 + 1], 6) as first_step, round(x[unnest(range(4)) * 16 + 16], 6) as last_step from vectors"))
def reshape_channels(spark, d):
    v = t.vectors(spark, d).select("id", F.posexplode(fe.channels("x", 4, STEPS)).alias("channel", "c"))
    return v.select("id", "channel", R(F.col("c")[0]).alias("first_step"), R(F.col("c")[STEPS - 1]).alias("last_step"))


def _down(how):
    return sql("vectors", f"""e as (select id, unnest(range(64)) as i, unnest(x) as v from vectors) select id, i // 4 as pos, round({how}(v), 6) as v from e group by id, i // 4""")


def _downsampled(spark, d, how):
    v = t.vectors(spark, d).select("id", F.posexplode(fe.downsample("x", 4, how)).alias("pos", "v"))
    return v.select("id", F.col("pos").cast("long").alias("pos"), R("v").alias("v"))


@query(_down("avg"))
def downsample_mean(spark, d):
    return _downsampled(spark, d, "mean")


@query(_down("median"))
def downsample_median(spark, d):
    return _downsampled(spark, d, "median")


_GRID = [("long", 1, 64), ("middle", 9, 32), ("short", 17, 16)]


@query(sql("vectors", "s as (" + " union all ".join(f"select id, case when id % 5 = 0 then 'test' else 'train' end as split, '{n}' as variable, x[{a}:{a + size - 1}] as x, {size // 16} as f from vectors" for n, a, size in _GRID) + """),
e as (select id, split, variable, f, unnest(x) as v, unnest(range(len(x))) as i from s), g as (select id, split, variable, i // f as place, avg(v) as v from e group by all)
select id, split, variable, place // 2 as pos, round(avg(v), 6) as v from g group by all"""))
def common_grid(spark, d):
    """Variables of three lengths on the shortest one's grid, then at thirty points a minute."""
    v = t.vectors(spark, d).withColumn("split", F.when(F.col("id") % 5 == 0, "test").otherwise("train"))
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("variable"), F.slice("x", a, size).alias("x")) for n, a, size in _GRID])).alias("e")
    g = fe.common_grid(v.select("id", "split", rows).select("id", "split", "e.*"), "mean", 30)
    return g.select("id", "split", "variable", F.posexplode("x").alias("pos", "v")).select("id", "split", "variable", F.col("pos").cast("long").alias("pos"), R("v").alias("v"))


def _by_label(spark, d):
    return t.vectors(spark, d).select("id", F.col("label").cast("string").alias("variable"), "x")


def _scaled_sql(centre, scale):
    return sql("vectors", f"""e as (select id, label, unnest(range(64)) as pos, unnest(x) as v from vectors), p as (select label, {centre} as c, {scale} as s from e where id % 5 != 0 group by label)
select id, pos, round((v - c) / s, 6) as z from e join p using (label)""")


def _scaled(spark, d, kind):
    v = _by_label(spark, d)
    z = fe.apply_scaler(v, fe.fit_scaler(v.where("id % 5 != 0"), kind))
    return z.select("id", F.posexplode("x").alias("pos", "z")).select("id", F.col("pos").cast("long").alias("pos"), R("z").alias("z"))


@query(_scaled_sql("median(v)", "quantile_cont(v, 0.9) - quantile_cont(v, 0.1)"))
def scale_robust(spark, d):
    return _scaled(spark, d, "robust")


@query(_scaled_sql("avg(v)", "stddev_pop(v)"))
def scale_standard(spark, d):
    return _scaled(spark, d, "standard")


@query(_scaled_sql("min(v)", "max(v) - min(v)"))
def minmax(spark, d):
    return _scaled(spark, d, "minmax")


@query(sql("vectors", """e as (select id, label, unnest(range(64)) as pos, 100 - unnest(x) as v from vectors), p as (select avg(v) as c, stddev_pop(v) as s from e) select id, pos, round((v - c) / s, 6) as z from e, p"""))
def flip_and_zscore(spark, d):
    v = _by_label(spark, d).withColumn("x", fe.flip_tail("x")).withColumn("variable", F.lit("all"))
    z = fe.apply_scaler(v, fe.fit_scaler(v, "standard"))
    return z.select("id", F.posexplode("x").alias("pos", "z")).select("id", F.col("pos").cast("long").alias("pos"), R("z").alias("z"))


@query()
def power_transform(spark, d):
    s = t.signal(spark, d)
    lam = fe.fit_power(s, "value")
    return fe.power_transform(s, "value", lam, "z").select("subject_id", "seq", R("z").alias("z"), F.lit(round(lam, 6)).alias("lambda"))


def _designed(spark, d, **kw):
    return fe.design_features(t.vectors(spark, d), CHANNELS, STEPS, step=4, **kw)


_CH = "c as (select id, " + ", ".join(f"x[{16 * i + 1}:{16 * i + 16}] as {n}" for i, n in enumerate(CHANNELS)) + " from vectors)"


@query(sql("vectors", _CH.replace("left", "lf").replace("right", "rg") + ", e as (" + " union all ".join(f"select id, {i} as pos, unnest({n}) as v from c" for i, n in enumerate(["abp", "hr", "lf", "rg"])) + """
 union all select id, 4 as pos, unnest(rg) - unnest(lf) as v from c)
select id, pos, round(avg(v), 6) as mean, round(stddev_pop(v), 6) as std from e group by id, pos"""))
def design_features(spark, d):
    f = _designed(spark, d, pair=("right", "left"))
    at = F.explode(F.sequence(F.lit(0), F.lit(4)))
    return f.select("id", "features", at.alias("pos")).select("id", "pos", R(F.get("features", F.col("pos"))).alias("mean"), R(F.get("features", F.col("pos") + 5)).alias("std"))


@query(sql("vectors", _CH.replace("left", "lf").replace("right", "rg") + """, p as (select id, 'hr' as name, abp as a, hr as b from c union all select id, 'left', abp, lf from c union all select id, 'right', abp, rg from c),
m as (select *, list_aggregate(a, 'avg') as ma, list_aggregate(b, 'avg') as mb, list_aggregate(a, 'stddev_pop') as sa, list_aggregate(b, 'stddev_pop') as sb from p),
k as (select *, unnest([-12, -8, -4, 0, 4, 8]) as lag from m), n as (select *, unnest(range(16)) as i from k)
select id, name, lag, round(sum((a[i + 1] - ma) * (b[i - lag + 1] - mb)) filter (where i - lag between 0 and 15) / (any_value(sa) * any_value(sb) * 16), 6) as r from n group by id, name, lag"""))
def lag_xcorr(spark, d):
    v, lags = t.vectors(spark, d), fe.lag_list(STEPS, 4)
    part = {n: F.slice("x", 16 * i + 1, 16) for i, n in enumerate(CHANNELS)}
    v = v.withColumns({n: fe.lagged_correlations(part["abp"], part[n], lags) for n in CHANNELS[1:]})
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(lag).alias("lag"), R(F.col(n)[k]).alias("r")) for n in CHANNELS[1:] for k, lag in enumerate(lags)]))
    return v.select("id", rows.alias("e")).select("id", "e.name", "e.lag", "e.r")


@query(sql("vectors", "select id, unnest(range(63)) as pos, round(x[unnest(range(63)) + 2] - x[unnest(range(63)) + 1], 6) as v from vectors"))
def whiten_diff(spark, d):
    v = t.vectors(spark, d).select("id", F.posexplode(fe.difference(F.col("x"))).alias("pos", "v"))
    return v.select("id", F.col("pos").cast("long").alias("pos"), R("v").alias("v"))


@query(sql("vectors", """e as (select id, label % 2 as y, unnest(range(64)) as feature, unnest(x) as v from vectors), q as (select feature, quantile_cont(v, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from e group by feature),
b as (select feature, y, len(list_filter(q.e, lambda z: v > z)) as bin from e join q using (feature)), j as (select feature, bin, y, count(*) as c from b group by all),
w as (select feature, c, sum(c) over (partition by feature) as n, sum(c) over (partition by feature, bin) as nx, sum(c) over (partition by feature, y) as ny from j)
select feature, round(sum(c / n * ln(c * n / (nx * ny))), 9) as mi from w group by feature"""))
def mutual_info_rank(spark, d):
    v = t.vectors(spark, d).withColumn("y", F.col("label") % 2)
    return fe.mutual_information(v, "y").select(F.col("feature").cast("long").alias("feature"), R("mi", 9).alias("mi"))


@query()
def mutual_info_near(spark, d):
    """The estimate from nearest neighbours."""
    v = t.vectors(spark, d).withColumn("y", F.col("label") % 2)
    return fe.mutual_information_near(v, "y").select(F.col("feature").cast("long").alias("feature"), R("mi", 9).alias("mi"))


_MI = ORACLES["mutual_info_rank"].replace("select feature, round(sum(c / n * ln(c * n / (nx * ny))), 9) as mi from w group by feature", ", m as (select feature, round(sum(c / n * ln(c * n / (nx * ny))), 9) as mi from w group by feature)")


@query(_MI.rstrip() + """, k as (select quantile_cont(mi, 0.8) as k, count(*) as n from m), r as (select m.*, mi > k as above, mi = k as tie, sum((mi > k)::int) over () as n_above, row_number() over (partition by mi = k order by feature) as place, n from m, k)
select feature, mi, above or (tie and place <= floor(n * 20 / 100.0) - n_above) as selected from r""")
def mutual_info_select(spark, d):
    """The fifth of the features that tell most about the class."""
    return fe.select_top(mutual_info_rank(spark, d), 20).select("feature", "mi", "selected")


@query()
def selected_features_model(spark, d):
    """A model on the selected features, scored on rows it hasn't seen."""
    v = _set(spark, d)
    top = fe.select_top(fe.mutual_information(v.where("id % 5 != 0"), "y"), 50)
    v = fe.keep_features(v, top)
    model = models.estimator("logreg_l2").fit(models.prepared(v.where("id % 5 != 0"), "x", "y"))
    out = models.scored(model, v.where("id % 5 = 0").withColumns({"_x": array_to_vector("x"), "_y": F.col("y").cast("double")}))
    return models.evaluate(out)


@query()
def pca_variance(spark, d):
    v = t.vectors(spark, d)
    train, test, shares = fe.pca_by_variance(v.where("id % 5 != 0"), v.where("id % 5 = 0"), variance=0.9)
    return train.unionByName(test).select("id", F.size("x").alias("components"), R(F.sqrt(_total(F.transform("x", lambda a: a * a)))).alias("norm"), F.lit(round(sum(shares), 6)).alias("explained"))


@query()
def separate_pca(spark, d):
    v = t.vectors(spark, d)
    parts = None
    for i, n in enumerate(CHANNELS):
        c = v.select("id", F.slice("x", 16 * i + 1, 16).alias("x"))
        train, test, _ = fe.pca_by_variance(c.where("id % 5 != 0"), c.where("id % 5 = 0"), variance=0.9)
        mine = train.unionByName(test).withColumnRenamed("x", n)
        parts = mine if parts is None else parts.join(mine, "id")
    joined = fe.concat_vectors(parts, CHANNELS)
    return joined.select("id", F.size("x").alias("components"), R(F.sqrt(_total(F.transform("x", lambda a: a * a)))).alias("norm"))


_KNN = """q as (select id, x from vectors where id % 10 = 0), d as (select q.id, v.id as nid, v.label, sqrt(list_aggregate(list_transform(list_zip(q.x, v.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])), 'sum')) as dist from q, vectors v where v.id != q.id),
k as (select *, row_number() over (partition by id order by dist, nid) as r from d qualify r <= 5)"""


def _near(spark, d, k=5):
    v = t.vectors(spark, d)
    return models.knn_join(v.where("id % 10 = 0"), v, "id", "nid", "x", "label", k)


@query(sql("vectors", _KNN + " select id, nid, r::int as rank, label, round(dist, 6) as distance from k"))
def knn_join(spark, d):
    return _near(spark, d).select("id", "nid", "rank", "label", R("distance").alias("distance"))


@query(sql("vectors", _KNN + ", v as (select id, label, count(*) as n from k group by all) select id, arg_max(label, (n, -label)) as yhat, max(n)::double as votes from v group by id"))
def knn_vote(spark, d):
    return models.knn_vote(_near(spark, d), "id")


@query(sql("vectors", _KNN + ", v as (select id, label, sum(1 / greatest(dist, 1e-12)) as n from k group by all) select id, arg_max(label, (round(n, 9), -label)) as yhat from v group by id"))
def knn_classifier(spark, d):
    return models.knn_vote(_near(spark, d), "id", "distance").select("id", "yhat")


def _set(spark, d):
    return t.vectors(spark, d).withColumn("y", (F.col("label") % 2).cast("int"))


def _fit(spark, d, kind, **params):
    v = _set(spark, d)
    model = models.estimator(kind, **params).fit(models.prepared(v.where("id % 5 != 0"), "x", "y"))
    out = models.scored(model, v.where("id % 5 = 0").withColumns({"_x": array_to_vector("x"), "_y": F.col("y").cast("double")}))
    return models.evaluate(out).withColumn("model", F.lit(kind))


@query()
def train_tree(spark, d):
    return _fit(spark, d, "tree")


@query()
def train_forest(spark, d):
    return _fit(spark, d, "forest", numTrees=10)


@query()
def train_gbt(spark, d):
    return _fit(spark, d, "gbt", maxIter=5)


@query()
def linear_svc(spark, d):
    return _fit(spark, d, "svc")


@query()
def score_and_evaluate(spark, d):
    return _fit(spark, d, "logreg_l2").unionByName(_fit(spark, d, "logreg_l1", regParam=0.02))


@query()
def holdout_confusion(spark, d):
    return models.holdout_confusion(_set(spark, d), "logreg_l2", "id", "x", "y")


def _kernels(n):
    """The seeded kernels as SQL rows."""
    rows = [f"({k}, [{', '.join(repr(float(x)) for x in w)}], {b!r}, {dil}, {(len(w) - 1) * dil})" for k, (w, b, dil) in enumerate(fe.convolution_kernels(64, n))]
    return "k(kid, w, b, dil, span) as (values " + ", ".join(rows) + ")"


@query(sql("vectors", _kernels(20) + """, n as (select id, x, list_aggregate(x, 'avg') as m, list_aggregate(x, 'stddev_pop') as s from vectors), z as (select id, list_transform(x, lambda v: (v - m) / s) as z from n),
c as (select id, kid, b, w, dil, z, unnest(range(64 - span)) as i from z, k),
v as (select id, kid, b + list_sum(list_transform(range(len(w)), lambda j: w[j + 1] * z[i + j * dil + 1])) as v from c), f as (select id, kid, avg((v > 0)::int) + max(v) as t from v group by all)
select id, (2 * count(*))::int as n, round(sum(t), 4) as total from f group by id"""))
def conv_features(spark, d):
    f = fe.convolution_features(_set(spark, d), "x", 20)
    return f.select("id", F.size("features").alias("n"), R(_total("features"), 4).alias("total"))


@query()
def conv_ridge(spark, d):
    """A ridge model on random convolutions, scored on rows it hasn't seen."""
    v = fe.convolution_features(_set(spark, d), "x", 40)
    model = models.estimator("ridge", regParam=1.0).fit(models.prepared(v.where("id % 5 != 0"), "features", "y"))
    out = models.scored(model, v.where("id % 5 = 0").withColumns({"_x": array_to_vector("features"), "_y": F.col("y").cast("double")}))
    return models.evaluate(out)


@query()
def random_search_summary(spark, d):
    """Three settings drawn at random on three folds: mean, deviation and gap of each."""
    v = _set(spark, d)
    grid = models.random_settings({"regParam": ("loguniform", 1e-3, 10.0), "elasticNetParam": ("choice", [0.0, 1.0])}, 3)
    return models.search_summary(models.cv_search(v, "logreg_l2", grid, split.group_kfold(v, "y", "id", 3, 1), "id", "x", "y")[1])


@query()
def cv_search_logreg(spark, d):
    v = _set(spark, d)
    folds = split.group_kfold(v, "y", "id", 3, 1)
    return models.cv_search(v, "logreg_l2", [{"regParam": 0.01}, {"regParam": 1.0}], folds, "id", "x", "y")[1]
