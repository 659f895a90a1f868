"""Queries over cohorts: distributions, coverage, correlations, splits, trials."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import DAY
from tidemark.operators import board, clean, models, split, stats
from tidemark.sources import tables as t
from tidemark.sources.tables import sql

QUERIES: dict = {}
ORACLES: dict = {}
R = lambda c, n=6: F.round(c, n)


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


LINE = "l_quantity l_extendedprice l_discount l_tax".split()


@query("""with b as (select min(l_extendedprice::double) as lo, max(l_extendedprice::double) as hi from lineitem),
k as (select least(floor((l_extendedprice::double - lo) / ((hi - lo) / 50)), 49)::int as bin, lo, hi from lineitem, b)
select bin, round(any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 50, 6) as left_edge, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from k group by bin""")
def histogram_fixed(spark, d):
    h = stats.histogram(t.table(spark, d, "lineitem"), "l_extendedprice", 50)
    return h.select("bin", R("left_edge").alias("left_edge"), "n", R("share", 9).alias("share"))


@query("""with b as (select l_returnflag, min(l_quantity::double) as lo, max(l_quantity::double) as hi from lineitem group by 1),
k as (select l_returnflag, least(floor((l_quantity::double - lo) / ((hi - lo) / 10)), 9)::int as bin, lo, hi from lineitem join b using (l_returnflag)),
h as (select l_returnflag, any_value(lo) + bin * (any_value(hi) - any_value(lo)) / 10 as e, count(*) as n from k group by l_returnflag, bin)
select l_returnflag, round(sum(n * e) / sum(n), 6) as hist_mean from h group by 1""")
def histogram_mean(spark, d):
    h = stats.histogram(t.table(spark, d, "lineitem"), "l_quantity", 10, ["l_returnflag"])
    return stats.histogram_mean(h, ["l_returnflag"]).select("l_returnflag", R("hist_mean").alias("hist_mean"))


@query("""select l_returnflag, count(l_extendedprice) as n, round(avg(l_extendedprice::double), 4) as mean, round(stddev_samp(l_extendedprice::double), 4) as std, min(l_extendedprice::double) as min,
 round(quantile_cont(l_extendedprice::double, 0.25), 4) as p25, round(quantile_cont(l_extendedprice::double, 0.5), 4) as p50, round(quantile_cont(l_extendedprice::double, 0.75), 4) as p75, round(quantile_cont(l_extendedprice::double, 0.9), 4) as p90, max(l_extendedprice::double) as max from lineitem group by 1""")
def describe_percentiles(spark, d):
    s = stats.describe(t.table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag"])
    return s.select("l_returnflag", "n", "min", "max", *[R(c, 4).alias(c) for c in ("mean", "std", "p25", "p50", "p75", "p90")])


@query("select l_linestatus, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from lineitem group by 1")
def value_share(spark, d):
    return stats.value_share(t.table(spark, d, "lineitem"), "l_linestatus").select("l_linestatus", "n", R("share", 9).alias("share"))


@query(sql("signal", "select variable, count(distinct subject_id) as subjects, round(100.0 * count(distinct subject_id) / (select count(distinct subject_id) from signal), 6) as percent from signal group by variable"))
def coverage(spark, d):
    return stats.coverage(t.signal(spark, d)).select("variable", "subjects", R("percent").alias("percent"))


@query(sql("signal", "select variable, count(distinct subject_id) as recordings from signal group by variable having count(distinct subject_id) > 0.8 * (select count(distinct subject_id) from signal)"))
def prevalence_filter(spark, d):
    return clean.prevalence(t.signal(spark, d)).where("share > 0.8").select("variable", "recordings")


@query("with c as (select l_quantity::double as q, l_extendedprice::double as e, l_discount::double as d, l_tax::double as t from lineitem)" + " union all ".join(
    f" select '{a}' as x, '{b}' as y, round(corr({a[2]}, {b[2]}), 8) as r from c" for i, a in enumerate(LINE) for b in LINE[i + 1 :]))
def pearson_matrix(spark, d):
    return stats.correlation_matrix(t.table(spark, d, "lineitem"), LINE).select("x", "y", R("r", 8).alias("r"))


@query()
def pearson_pvalue(spark, d):
    return stats.pearson_pvalue(t.table(spark, d, "lineitem"), [(a, b) for i, a in enumerate(LINE) for b in LINE[i + 1 :]])


@query("""with p as (select l_partkey as id, count(*) as n, avg(l_discount::double) as p from lineitem group by 1),
r as (select *, p * count(*) over () / row_number() over (order by p, id) as raw from p)
select id, round(p, 9) as p, round(least(1.0, min(raw) over (order by p, id rows between current row and unbounded following)), 9) as q from r""")
def bh_fdr(spark, d):
    p = t.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.avg(F.col("l_discount").cast("double")).alias("p"))
    return stats.benjamini_hochberg(p, "p").select("id", R("p", 9).alias("p"), R("q", 9).alias("q"))


@query("select doc_id from documents semi join labels using (doc_id) order by doc_id")
def with_both_sources(spark, d):
    return t.table(spark, d, "documents").select("doc_id").join(t.table(spark, d, "labels").select("doc_id"), "doc_id", "left_semi")


@query("select doc_id from documents except select doc_id from labels")
def without_labels(spark, d):
    return t.table(spark, d, "documents").select("doc_id").subtract(t.table(spark, d, "labels").select("doc_id"))


@query("select doc_id from documents intersect select doc_id from labels")
def shared_ids(spark, d):
    return t.table(spark, d, "documents").select("doc_id").intersect(t.table(spark, d, "labels").select("doc_id"))


@query(sql("segments limits", """p as (select subject_id, min(ts_us) as a, max(ts_us) as b from limits where lower is not null and upper is not null group by subject_id),
v as (select distinct subject_id from signal where variable = 'purchase')
select s.subject_id, s.segment, v.subject_id is null as lacks_purchase from segments s join p using (subject_id) left join v using (subject_id) where s.end_us >= a and s.start_us <= b"""))
def label_coverage(spark, d):
    lim = t.limits(spark, d)
    good = clean.reject_all_null(lim, "subject_id", ["lower", "upper"])
    found = clean.period_overlap(t.segments(spark, d), lim.where("lower is not null and upper is not null")).join(good, "subject_id", "left_semi")
    return clean.flag_missing(found, t.signal(spark, d), "purchase", "lacks_purchase").select("subject_id", "segment", "lacks_purchase")


@query(sql("signal limits segments", """v as (select distinct subject_id from signal where variable = 'view') select segment, count(*) as recordings from segments semi join v using (subject_id) group by segment"""))
def required_variable(spark, d):
    return clean.require_variable(t.segments(spark, d), t.signal(spark, d), "view").groupBy("segment").agg(F.count("*").alias("recordings"))


_STRATA = """s as (select o_custkey, sum(o_totalprice::double) as a, count(*)::double as b, max(o_totalprice::double) as c from orders group by 1),
q as (select quantile_cont(a, 1/3.) as a1, quantile_cont(a, 2/3.) as a2, quantile_cont(b, 1/3.) as b1, quantile_cont(b, 2/3.) as b2, quantile_cont(c, 1/3.) as c1, quantile_cont(c, 2/3.) as c2 from s),
t as (select o_custkey, (a > a1 + 1e-9 * a1)::int + (a > a2 + 1e-9 * a2)::int as ta, (b > b1 + 1e-9 * b1)::int + (b > b2 + 1e-9 * b2)::int as tb, (c > c1 + 1e-9 * c1)::int + (c > c2 + 1e-9 * c2)::int as tc from s, q)"""


def _strata(spark, d):
    o = t.table(spark, d, "orders").withColumn("p", F.col("o_totalprice").cast("double"))
    s = o.groupBy("o_custkey").agg(F.sum("p").alias("a"), F.count("*").cast("double").alias("b"), F.max("p").alias("c"))
    s = split.tertiles_of(s, {c: f"t{c}" for c in "abc"})
    return s.withColumn("stratum", split.stratum(["ta", "tb", "tc"]))


@query("with " + _STRATA + " select o_custkey, ta, tb, tc, ta::varchar || tb::varchar || tc::varchar as stratum from t")
def tertile_strata(spark, d):
    return _strata(spark, d).select("o_custkey", "ta", "tb", "tc", "stratum")


_MD5 = lambda key, salt: f"md5({key}::varchar || ':' || ({salt})::varchar)"


@query("with " + _STRATA + f""", u as (select o_custkey, ta::varchar || tb::varchar || tc::varchar as stratum from t),
z as (select stratum, count(*) as n from u group by 1), b as (select *, floor(n * 0.8) as base, row_number() over (order by round(n * 0.8 - floor(n * 0.8), 9) desc, stratum) as k from z),
w as (select stratum, base + (k <= (select round(sum(n) * 0.8) - sum(base) from b))::int as train from b),
r as (select o_custkey, stratum, row_number() over (partition by stratum order by {_MD5('o_custkey', 42)}, o_custkey) as k from u)
select o_custkey, stratum, case when k <= train then 'train' else 'test' end as split from r join w using (stratum)""")
def stratified_split(spark, d):
    return split.stratified_split(_strata(spark, d), "o_custkey", "stratum").select("o_custkey", "stratum", "split")


@query("with " + _STRATA + """, z as (select ta::varchar || tb::varchar || tc::varchar as stratum, count(*) as n from t group by 1),
b as (select *, floor(n * 0.8) as base, row_number() over (order by round(n * 0.8 - floor(n * 0.8), 9) desc, stratum) as k from z)
select stratum, n, (base + (k <= (select round(sum(n) * 0.8) - sum(base) from b))::int)::bigint as train from b""")
def split_sizes(spark, d):
    s = split.stratified_split(_strata(spark, d), "o_custkey", "stratum")
    return s.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if(F.col("split") == "train").alias("train"))


def _labelled(spark, d):
    return t.limits(spark, d).withColumn("y", F.col("mean").between(F.col("lower"), F.col("upper")).cast("int")).where("y is not null")


def _folds(k, repeats, seed=42):
    """SQL of split.group_kfold over the labelled subject-days."""
    return f"""y as (select subject_id, day, (mean between lower and upper)::int as y from limits where mean between lower and upper is not null),
p as (select subject_id, count(*) as n, avg(y::double) as rate from y group by 1), b as (select *, (floor(log2(n)) * 100 + floor(rate * 10))::bigint as band from p),
e as (select *, unnest(range({repeats}))::int as repeat from b),
f as (select *, row_number() over (partition by repeat, band order by {_MD5('subject_id', f'repeat + {seed}')}, subject_id) - 1 + ('0x' || substr({_MD5('band', f'repeat + {seed}')}, 1, 8))::bigint % {k} as r from e),
folds as (select subject_id, repeat, (case when (r // {k}) % 2 = 0 then r % {k} else {k} - 1 - r % {k} end)::int as fold, n, rate from f)"""


@query(sql("limits", _folds(5, 3) + " select * from folds"))
def group_kfold(spark, d):
    return split.group_kfold(_labelled(spark, d), "y", "subject_id", 5, 3)


@query(sql("signal", f"x as (select distinct subject_id from signal) select subject_id from x order by {_MD5('subject_id', 42)}, subject_id limit 20"))
def hash_sample(spark, d):
    return split.hash_sample(t.signal(spark, d).select("subject_id").distinct(), "subject_id", 20)


@query(sql("limits", "y as (select subject_id, (mean between lower and upper)::int as y from limits where mean between lower and upper is not null) select repeat, count(*) as n, sum(y)::bigint as positives from y cross join range(3) as r(repeat) group by repeat").replace("select repeat,", "select repeat::int as repeat,"))
def balanced_group_kfold(spark, d):
    """Folds of balanced label shares over three repeats: every subject is in one fold of each, so each repeat adds up to all rows."""
    folds = split.balanced_group_kfold(_labelled(spark, d), "y", "subject_id", 5, 3)
    return folds.groupBy("repeat").agg(F.sum("n").alias("n"), F.sum("positives").alias("positives"))


@query(sql("limits", _folds(3, 1) + " select subject_id, day, y from y semi join (select subject_id from folds where fold = 0) using (subject_id)"))
def group_subsample(spark, d):
    """Whole subjects with about a third of the rows."""
    rows = _labelled(spark, d)
    n = rows.count()
    return split.group_subsample(rows, "y", "subject_id", max(1, n // 3), 3 * max(1, n // 3)).select("subject_id", "day", "y")


@query("select 'doc' as kind, quality as y, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as percent from labels group by quality")
def class_balance(spark, d):
    s = stats.value_share(t.table(spark, d, "labels"), "quality")
    return s.select(F.lit("doc").alias("kind"), F.col("quality").alias("y"), "n", R(F.col("share") * 100).alias("percent"))


@query("select count(distinct l_linestatus) as modes, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers from lineitem")
def distinct_values(spark, d):
    return t.table(spark, d, "lineitem").agg(F.count_distinct("l_linestatus").alias("modes"), F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("select round(avg(l_extendedprice::double), 4) as mean, round(stddev_pop(l_extendedprice::double), 4) as std, min(l_extendedprice::double) as min, max(l_extendedprice::double) as max, count(l_extendedprice) as n from lineitem")
def global_moments(spark, d):
    m = stats.moments(t.table(spark, d, "lineitem"), "l_extendedprice")
    return m.select(R("mean", 4).alias("mean"), R("std", 4).alias("std"), "min", "max", "n")


@query("""with a as (select count(*) as n, count(*) filter (where l_discount > 0.05) as big, count(*) filter (where l_returnflag like '%A%') as air, count(*) filter (where l_quantity >= 40) as many from lineitem)
select 'big_discount' as condition, big as n, round(big / n, 9) as share from a union all select 'accepted', air, round(air / n, 9) from a union all select 'many', many, round(many / n, 9) from a""")
def conditional_share(spark, d):
    s = stats.conditional_share(t.table(spark, d, "lineitem"), {"big_discount": F.col("l_discount") > 0.05, "accepted": F.col("l_returnflag").contains("A"), "many": F.col("l_quantity") >= 40})
    return s.select("condition", "n", R("share", 9).alias("share"))


@query("""with x as (select c_custkey, case when c_custkey % 7 = 0 then null else c_acctbal::double end as v from customer) select c_custkey, round(coalesce(v, (select avg(v) from x)), 4) as v from x""")
def mean_fill(spark, d):
    c = t.table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal").cast("double")).alias("v"))
    return clean.mean_fill(c, ["v"]).select("c_custkey", R("v", 4).alias("v"))


@query("""select c_custkey, coalesce(try_cast(nullif(trim(case when c_custkey % 5 = 0 then ' ' when c_custkey % 11 = 0 then 'x' else split_part(c_name, '#', 2) end), '') as int), -1) as code, (c_acctbal > 0)::int as positive from customer""")
def cast_clean(spark, d):
    c = t.table(spark, d, "customer").withColumn("text", F.when(F.col("c_custkey") % 5 == 0, " ").when(F.col("c_custkey") % 11 == 0, "x").otherwise(F.split_part("c_name", F.lit("#"), F.lit(2))))
    return c.select("c_custkey", clean.blank_to_code("text").alias("code"), (F.col("c_acctbal") > 0).cast("int").alias("positive"))


@query("select l_orderkey as id, 'line' as kind, l_returnflag as mode, null as priority from lineitem union all select o_orderkey, 'order', null, o_orderpriority from orders")
def union_sources(spark, d):
    a = t.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("line").alias("kind"), F.col("l_returnflag").alias("mode"))
    b = t.table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.lit("order").alias("kind"), F.col("o_orderpriority").alias("priority"))
    return a.unionByName(b, allowMissingColumns=True)


# trials


@query(sql("trial_results", "select brand, type, auc, balanced_accuracy from trial_results a where not exists (select 1 from trial_results b where b.auc >= a.auc and b.balanced_accuracy >= a.balanced_accuracy and (b.auc > a.auc or b.balanced_accuracy > a.balanced_accuracy))"))
def pareto_front(spark, d):
    return board.pareto_front(t.trial_results(spark, d), "auc", "balanced_accuracy").select("brand", "type", "auc", "balanced_accuracy")


@query("""with c as (select o_custkey as custkey, count(*) as orders, round(max(o_totalprice)::double, 2) as largest, round(min(o_totalprice)::double, 2) as smallest, datediff('day', date '1970-01-01', max(o_orderdate)::date)::bigint as latest from orders group by 1)
select * from c a where not exists (select 1 from c b where b.orders >= a.orders and b.largest >= a.largest and b.smallest >= a.smallest and b.latest >= a.latest and (b.orders > a.orders or b.largest > a.largest or b.smallest > a.smallest or b.latest > a.latest))""")
def pareto_front_of_four(spark, d):
    """Customers that no other one surpasses in number, largest, smallest and latest order."""
    o, price = t.table(spark, d, "orders"), F.col("o_totalprice").cast("double")
    c = o.groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("orders"), F.round(F.max(price), 2).alias("largest"), F.round(F.min(price), 2).alias("smallest"), F.datediff(F.max("o_orderdate").cast("date"), F.lit("1970-01-01")).cast("long").alias("latest"))
    return board.pareto_front(c, "orders", "largest", "smallest", "latest")


def _board_parts(spark, d):
    part = t.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"))
    line = t.table(spark, d, "lineitem").withColumn("third", F.col("l_orderkey") % 3)
    j = line.join(part, line["l_partkey"] == part["p_partkey"])
    pick = lambda k, n: j.where(F.col("third") == k).groupBy("brand").agg(R(F.avg(F.col("l_discount").cast("double")), 9).alias(n))
    return pick(0, "train_auc"), pick(1, "val_auc"), pick(2, "test_auc")


@query("""with j as (select p_brand as brand, l_orderkey % 3 as third, l_discount::double as v from lineitem join part on p_partkey = l_partkey),
a as (select brand, round(avg(v), 9) as train_auc from j where third = 0 group by 1), b as (select brand, round(avg(v), 9) as val_auc from j where third = 1 group by 1), c as (select brand, round(avg(v), 9) as test_auc from j where third = 2 group by 1)
select brand, train_auc, val_auc, test_auc, rank() over (order by val_auc desc)::int as rank from a join b using (brand) join c using (brand)""")
def leaderboard(spark, d):
    return board.leaderboard(*_board_parts(spark, d), ["brand"], "val_auc")


@query(sql("trial_results", "select * from (select brand, type, auc, row_number() over (partition by brand order by auc desc, type)::int as rank from trial_results) where rank <= 3"))
def topk_per_group(spark, d):
    return board.top_k(t.trial_results(spark, d), ["brand"], [F.col("auc").desc(), "type"], 3).select("brand", "type", "auc", "rank")


@query(sql("trial_results", "select brand, type, 'auc' as metric, auc as value from trial_results union all select brand, type, 'balanced_accuracy', balanced_accuracy from trial_results"))
def melt_metrics(spark, d):
    return board.melt(t.trial_results(spark, d).select("brand", "type", "auc", "balanced_accuracy"), ["brand", "type"], ["auc", "balanced_accuracy"])


@query(sql("trial_results", "select brand, type, round(std_auc / sqrt(15.0) * 1.96, 9) as halfwidth from trial_results"))
def ci_halfwidth(spark, d):
    return t.trial_results(spark, d).select("brand", "type", R(stats.ci_halfwidth("std_auc"), 9).alias("halfwidth"))


@query(sql("trial_results", "select brand, type, auc, round(m, 9) as auc_group_mean from (select *, row_number() over (partition by brand order by auc desc, type) as k, avg(auc) over (partition by brand) as m from trial_results) where k = 1"))
def best_per_group(spark, d):
    return stats.best_per_group(t.trial_results(spark, d), ["brand"], "auc", ["type"]).select("brand", "type", "auc", R("auc_group_mean", 9).alias("auc_group_mean"))


@query(sql("trial_results", "select brand, type, auc, rank() over (order by auc desc)::int as rank from trial_results"))
def rank_trials(spark, d):
    from pyspark.sql import Window

    return t.trial_results(spark, d).select("brand", "type", "auc", F.rank().over(Window.orderBy(F.col("auc").desc())).alias("rank"))


@query(sql("trial_results", "select brand, type, auc from trial_results order by auc desc, brand, type limit 1"))
def best_row(spark, d):
    return t.trial_results(spark, d).select("brand", "type", "auc").orderBy(F.col("auc").desc(), "brand", "type").limit(1)


@query("""with j as (select p_brand as brand, p_type as fold, avg(l_discount::double) as train, avg(l_tax::double) as val from lineitem join part on p_partkey = l_partkey group by all)
select brand, round(avg(train), 9) as mean_train, round(stddev_pop(train), 9) as std_train, round(avg(val), 9) as mean_val, round(stddev_pop(val), 9) as std_val, round(avg(train) - avg(val), 9) as gap from j group by brand""")
def fold_summary(spark, d):
    part = t.table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_type").alias("fold"))
    line = t.table(spark, d, "lineitem")
    j = line.join(part, line["l_partkey"] == part["p_partkey"]).groupBy("brand", "fold").agg(F.avg(F.col("l_discount").cast("double")).alias("train"), F.avg(F.col("l_tax").cast("double")).alias("val"))
    s = board.fold_summary(j, ["brand"], "train", "val")
    return s.select("brand", *[R(c, 9).alias(c) for c in ("mean_train", "std_train", "mean_val", "std_val", "gap")])


@query("select p_brand || '_x_' || p_type as name, p_brand || '_x' as model, p_type as datamode, count(*) as n from part group by all")
def split_name(spark, d):
    names = t.table(spark, d, "part").groupBy(F.concat_ws("_", "p_brand", F.lit("x"), "p_type").alias("name")).agg(F.count("*").alias("n"))
    return board.split_name(names, "name").select("name", "model", "datamode", "n")


@query("""select '--brand=' || brand || ' --mode=' || mode || ' --flag=' || flag as setting, brand, mode, flag from (select distinct p_brand as brand from part), (select distinct p_type as mode from part), (select distinct l_returnflag as flag from lineitem)""")
def param_grid(spark, d):
    values = lambda name, column, c: t.table(spark, d, name).select(F.lit(name).alias("name"), F.col(column).alias("value")).withColumn("name", F.lit(c)).distinct()
    every = values("part", "p_brand", "brand").union(values("part", "p_type", "mode")).union(values("lineitem", "l_returnflag", "flag"))
    return board.grid_of(every, ["brand", "mode", "flag"]).select("setting", "brand", "mode", "flag")


# scores


@query(sql("scores", "select y, (score >= 1500)::int as yhat, count(*) as n, round(count(*) / sum(count(*)) over (), 9) as share from scores group by all"))
def confusion(spark, d):
    s = t.scores(spark, d).withColumn("yhat", (F.col("score") >= 1500).cast("int"))
    return models.confusion(s).select("y", "yhat", "n", R("share", 9).alias("share"))


@query(sql("scores", """r as (select *, rank() over (order by score) + (count(*) over (partition by score) - 1) / 2.0 as r from scores), a as (select count(*) filter (where y = 1) as n_pos, count(*) filter (where y = 0) as n_neg, sum(r) filter (where y = 1) as s from r)
select n_pos, n_neg, round((s - n_pos * (n_pos + 1) / 2.0) / (n_pos * n_neg), 9) as auc from a"""))
def roc_auc(spark, d):
    return models.roc_auc(t.scores(spark, d), "score", "y").select("n_pos", "n_neg", R("auc", 9).alias("auc"))


@query(sql("scores", "select round(avg(r), 9) as balanced_accuracy from (select y, avg((y = (score >= 1500)::int)::int) as r from scores group by y)"))
def balanced_accuracy(spark, d):
    s = t.scores(spark, d).withColumn("yhat", (F.col("score") >= 1500).cast("int"))
    return models.balanced_accuracy(s).select(R("balanced_accuracy", 9).alias("balanced_accuracy"))


@query(sql("scores", """c as (select distinct score as threshold from scores), n as (select count(*) filter (where y = 1) as p, count(*) filter (where y = 0) as q from scores),
v as (select threshold, round((count(*) filter (where y = 1 and score >= threshold) / any_value(p) + count(*) filter (where y = 0 and score < threshold) / any_value(q)) / 2, 12) as b from c, scores, n group by threshold)
select threshold, b as balanced_accuracy from v order by b desc, threshold limit 1"""))
def best_threshold(spark, d):
    return models.best_threshold(t.scores(spark, d), "score", "y")
