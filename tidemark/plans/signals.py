"""Queries over signals, limits, segments and their windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import DAY, HOUR
from tidemark.operators import clean, episodes, intervals, labels, windows
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


@query(sql("limits", """select subject_id, round(sum((mean between lower and upper)::int * n) / sum(n), 6) as share_inside,
 round(1 - sum((mean between lower and upper)::int * n) / sum(n), 6) as share_outside from limits where mean between lower and upper is not null group by subject_id"""))
def time_outside_share(spark, d):
    known = t.limits(spark, d).withColumn("inside", labels.mean_rule(None)).where("inside is not null")
    return labels.inside_share(known, "subject_id", "inside", "n").select("subject_id", R("share_inside").alias("share_inside"), R("share_outside").alias("share_outside"))


@query(sql("signal limits", """, w as (select l.subject_id, l.ts_us, l.lower, l.upper, s.value, count(*) over (partition by l.subject_id, l.ts_us) as k
 from limits l join signal s on s.subject_id = l.subject_id and s.ts_us >= l.ts_us - 259200000000 and s.ts_us < l.ts_us),
g as (select subject_id, ts_us, count(*) filter (where value between lower and upper) as n_in, count(*) filter (where value < lower or value > upper) as n_out, max(k) as k from w group by all),
h as (select *, n_in / greatest(k, 8)::double as a, n_out / greatest(k, 8)::double as b from g)
select subject_id, ts_us, n_in, n_out, case when abs(a - b) >= 1 - a - b and n_in + n_out > 0 then a / (a + b) > 0.5 end as inside from h""".lstrip(", ")))
def count_rule_labels(spark, d):
    w = windows.samples_in(t.limits(spark, d).select("subject_id", "ts_us", "lower", "upper"), t.signal(spark, d), "count", 3 * DAY)
    k = F.count("*").over(Window.partitionBy("subject_id", "ts_us"))
    w = w.withColumn("k", F.greatest(k, F.lit(8)))
    return labels.count_rule(w, ["subject_id", "ts_us"], F.col("k")).select("subject_id", "ts_us", "n_in", "n_out", "inside")


@query(sql("daily limits", """w as (select l.subject_id, l.ts_us, l.lower, l.upper, s.mean as value from limits l join daily s on s.subject_id = l.subject_id and s.ts_us >= l.ts_us - 604800000000 and s.ts_us < l.ts_us),
g as (select subject_id, ts_us, count(*) filter (where value between lower and upper) as n_in, count(*) filter (where value < lower or value > upper) as n_out from w group by all), h as (select *, n_in / 7.0::double as a, n_out / 7.0::double as b from g)
select subject_id, ts_us, n_in, n_out, case when abs(a - b) >= 1 - a - b and n_in + n_out > 0 then a / (a + b) > 0.5 end as inside from h"""))
def count_rule_by_day(spark, d):
    """A week's daily means against limits: seven are expected, and days without a mean are missing."""
    daily = t.daily(spark, d).select("subject_id", "ts_us", F.col("mean").alias("value"))
    w = windows.samples_in(t.limits(spark, d).select("subject_id", "ts_us", "lower", "upper"), daily, "count", 7 * DAY)
    return labels.count_rule(w, ["subject_id", "ts_us"], F.lit(7)).select("subject_id", "ts_us", "n_in", "n_out", "inside")


@query(sql("limits", """s as (select subject_id, ts_us, avg((mean not between lower and upper)::int) over w as o, count((mean not between lower and upper)::int) over w as k, count(*) over w as c, ts_us - first(ts_us) over w as span
 from limits window w as (partition by subject_id order by ts_us rows between 2 preceding and current row))
select subject_id, ts_us, case when c = 3 and span = 172800000000 and k = 3 then round(o, 6) end as share_outside, case when c = 3 and span = 172800000000 and k = 3 then o <= 0.46 end as inside from s"""))
def smooth_rule_labels(spark, d):
    s = labels.smooth_rule(t.limits(spark, d), "subject_id", "ts_us", 3, DAY)
    return s.select("subject_id", "ts_us", R("share_outside").alias("share_outside"), "inside")


@query(sql("bad", "select * from bad"))
def quality_intervals(spark, d):
    return intervals.change_points(t.quality(spark, d), "subject_id", "ts_us", "value").where("value != 0").drop("value")


def _bad(spark, d):
    return quality_intervals(spark, d)


@query(sql("segments bad", """e as (select subject_id, start_us as t, 1 as v, 0 as b from segments where end_us > start_us union all select subject_id, end_us, -1, 0 from segments where end_us > start_us
 union all select subject_id, start_us, 0, 1 from bad where end_us > start_us union all select subject_id, end_us, 0, -1 from bad where end_us > start_us),
n as (select subject_id, t, sum(v) as v, sum(b) as b from e group by all),
s as (select subject_id, t as start_us, lead(t) over w as end_us, sum(v) over w as v, sum(b) over w as b from n window w as (partition by subject_id order by t)),
g as (select subject_id, start_us, end_us from s where v > 0 and b = 0 and end_us > start_us),
o as (select g.*, segment from g join segments q on q.subject_id = g.subject_id and q.start_us <= g.start_us and q.end_us >= g.end_us),
r as (select *, sum(f) over (partition by subject_id, segment order by start_us) as run from (select *, case when lag(end_us) over (partition by subject_id, segment order by start_us) = start_us then 0 else 1 end as f from o))
select subject_id, segment, min(start_us) as start_us, max(end_us) as end_us from r group by subject_id, segment, run"""))
def subtract_intervals(spark, d):
    return intervals.subtract(t.segments(spark, d), _bad(spark, d))


@query(sql("segments daily", """p as (select subject_id, ts_us + 43200000000 as ts_us from daily)
select p.subject_id, p.ts_us, min(segment) as segment from p join segments s on s.subject_id = p.subject_id and s.start_us <= p.ts_us and p.ts_us < s.end_us group by p.subject_id, p.ts_us"""))
def label_segment_assign(spark, d):
    points = t.daily(spark, d).select("subject_id", (F.col("ts_us") + DAY // 2).alias("ts_us"))
    return intervals.assign(points, t.segments(spark, d), bucket_us=7 * DAY).select("subject_id", "ts_us", "segment")


@query(sql("segments daily", """p as (select subject_id, ts_us + 43200000000 as ts_us from daily),
a as (select p.subject_id, p.ts_us, s.start_us, s.end_us, segment from p join segments s on s.subject_id = p.subject_id and s.start_us <= p.ts_us and p.ts_us < s.end_us),
g as (select *, (greatest(0, start_us - (ts_us - 86400000000)) + greatest(0, ts_us - end_us))::bigint as gap_us from a)
select subject_id, ts_us, segment, ts_us - 86400000000 as window_start, ts_us as window_end, gap_us, round(gap_us / 86400000000.0, 6) as gap_share from g where gap_us / 86400000000.0 <= 0.5"""))
def window_overlap(spark, d):
    points = t.daily(spark, d).select("subject_id", (F.col("ts_us") + DAY // 2).alias("ts_us"))
    found = intervals.assign(points, t.segments(spark, d), bucket_us=7 * DAY)
    return windows.overlap(found, "count", DAY, 0.5).select("subject_id", "ts_us", "segment", "window_start", "window_end", "gap_us", R("gap_share").alias("gap_share"))


@query(sql("signal daily", """select d.subject_id, d.ts_us, count(*) as n, round(list_aggregate(list(s.value order by s.ts_us, s.value), 'sum'), 4) as total, round(list(s.value order by s.ts_us, s.value)[1], 6) as first_value, round(list(s.value order by s.ts_us, s.value)[-1], 6) as last_value
 from daily d join signal s on s.subject_id = d.subject_id and s.ts_us >= d.ts_us - 172800000000 and s.ts_us < d.ts_us group by d.subject_id, d.ts_us"""))
def lookback_vectors(spark, d):
    w = windows.samples_in(t.daily(spark, d).select("subject_id", "ts_us"), t.signal(spark, d), "before", 2 * DAY)
    x = windows.vectors(w, ["subject_id", "ts_us"])
    total = F.round(F.aggregate("x", F.lit(0.0), lambda s, v: s + v), 4)
    return x.select("subject_id", "ts_us", F.size("x").cast("long").alias("n"), total.alias("total"), R(F.col("x")[0]).alias("first_value"), R(F.element_at("x", -1)).alias("last_value"))


@query(sql("signal daily", """select d.subject_id, d.ts_us, s.ts_us as at_us, round(s.value, 6) as value from daily d join signal s on s.subject_id = d.subject_id and s.ts_us >= d.ts_us - 43200000000 and s.ts_us < d.ts_us + 43200000000"""))
def window_samples(spark, d):
    w = windows.samples_in(t.daily(spark, d).select("subject_id", "ts_us"), t.signal(spark, d), "within", DAY, salt=2)
    return w.select("subject_id", "ts_us", "at_us", R("value").alias("value"))


@query(sql("daily", """r as (select subject_id, min(day) as a, max(day) as b from daily group by subject_id),
g as (select subject_id, unnest(range(a, b + 1)) as day from r),
f as (select g.subject_id, g.day, g.day // 10 as block, mean from g left join daily using (subject_id, day)),
m as (select *, avg((mean is null)::int) over (partition by subject_id, block) as missing,
 max(case when mean is not null then day end) over (partition by subject_id, block order by day rows unbounded preceding) as t0, min(case when mean is not null then day end) over (partition by subject_id, block order by day rows between current row and unbounded following) as t1 from f),
v as (select m.*, p.mean as v0, q.mean as v1 from m left join f p on p.subject_id = m.subject_id and p.day = t0 and p.block = m.block left join f q on q.subject_id = m.subject_id and q.day = t1 and q.block = m.block)
select subject_id, block, day, round(case when mean is not null then mean when t0 is null then v1 when t1 is null then v0 else v0 + (v1 - v0) * (day - t0) / (t1 - t0) end, 6) as mean from v where missing <= 0.5 and (v0 is not null or v1 is not null)"""))
def impute_linear(spark, d):
    daily = t.daily(spark, d).select("subject_id", "day", "mean")
    span = daily.groupBy("subject_id").agg(F.min("day").alias("a"), F.max("day").alias("b"))
    grid = span.select("subject_id", F.explode(F.sequence("a", "b")).alias("day"))
    full = grid.join(daily, ["subject_id", "day"], "left").withColumn("block", F.floor(F.col("day") / 10))
    return windows.impute_linear(full, ["subject_id", "block"], "day", "mean", 0.5).select("subject_id", "block", "day", R("mean").alias("mean"))


@query(sql("signal", """, recursive k(subject_id, ts_us) as (select subject_id, min(ts_us) from signal group by subject_id
 union all select n.subject_id, n.ts_us from (select k.subject_id, (select min(s.ts_us) from signal s where s.subject_id = k.subject_id and s.ts_us - k.ts_us >= 172800000000) as ts_us from k) n where n.ts_us is not null)
select * from k""".lstrip(", ")).replace("with signal", "with recursive signal").replace(", recursive k", ", k").replace(") recursive k", "), k"))
def stride_thinning(spark, d):
    return windows.thin(t.signal(spark, d), "subject_id", "ts_us", 2 * DAY)


@query(sql("segments", """h as (select subject_id, segment, (start_us // 3600000000) * 3600000000 as start_us, length from segments),
e as (select *, start_us + length * 3600000000 as stop, lead(start_us) over (partition by subject_id order by start_us) as nxt, min(start_us) over (partition by subject_id) as zero from h),
a as (select subject_id, start_us - zero + i * 3600000000 as rel_us, i::double as value from (select *, unnest(range(length)) as i from e)),
b as (select subject_id, stop - zero + i * 3600000000 as rel_us, null::double as value from (select *, unnest(range(greatest((nxt - stop) // 3600000000, 0))) as i from e where nxt is not null))
select * from a union all select * from b"""))
def gap_fill_grid(spark, d):
    s = t.segments(spark, d).select("subject_id", F.col("segment").alias("segment_id"), (F.floor(F.col("start_us") / HOUR) * HOUR).alias("start_us"), F.lit(1 / 3600).alias("frequency"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("length") - 1), lambda i: i.cast("double")).alias("samples"))
    return windows.gap_fill(s)


_FLAGGED = "flagged as (select subject_id, ts_us, day, mean, coalesce(mean not between lower and upper, false) as out from limits)"
_RUNS = _FLAGGED + """, runs as (select *, (sum(f) over (partition by subject_id order by ts_us))::bigint as run from (select *, case when lag(out) over w is not distinct from out and row_number() over w > 1 then 0 else 1 end as f, coalesce(lag(ts_us) over w, ts_us - 86400000000) as prior from flagged window w as (partition by subject_id order by ts_us)))"""
_EPISODES = _RUNS + ", ep as (select subject_id, run, min(prior) as start_us, max(ts_us) as end_us, count(*) as n, max(ts_us) - min(prior) as duration_us from runs where out group by subject_id, run)"


def _flagged(spark, d):
    return t.limits(spark, d).withColumn("out", F.coalesce(~F.col("mean").between(F.col("lower"), F.col("upper")), F.lit(False))).select("subject_id", "ts_us", "day", "mean", "out")


@query(sql("limits", _RUNS + " select subject_id, ts_us, out, run from runs"))
def run_ids(spark, d):
    return episodes.run_ids(_flagged(spark, d), "subject_id", ["ts_us"], "out").select("subject_id", "ts_us", "out", "run")


@query(sql("limits", _EPISODES + " select * from ep"))
def outside_episodes(spark, d):
    return episodes.outside_episodes(_flagged(spark, d), "subject_id", ["ts_us"], "out", DAY)


@query(sql("limits", _EPISODES + """, rec as (select subject_id, max(ts_us) - min(ts_us) as recorded from limits group by subject_id)
select subject_id, count(*) as episodes, round(avg(duration_us / 6e7), 6) as mean_min, round(median(duration_us / 6e7), 6) as median_min, round(stddev_samp(duration_us / 6e7), 6) as std_min, round(max(duration_us / 6e7), 6) as max_min, round(min(duration_us / 6e7), 6) as min_min,
 round(case when any_value(recorded) != 0 then count(*) * 3600e6 / any_value(recorded) end, 6) as per_hour from ep join rec using (subject_id) group by subject_id"""))
def episode_stats(spark, d):
    recorded = t.limits(spark, d).groupBy("subject_id").agg((F.max("ts_us") - F.min("ts_us")).alias("recorded_us"))
    s = episodes.episode_stats(outside_episodes(spark, d), "subject_id", "duration_us", recorded)
    return s.select("subject_id", "episodes", *[R(c).alias(c) for c in ("mean_min", "median_min", "std_min", "max_min", "min_min", "per_hour")])


@query(sql("clustered", "select subject_id, ts_us, seq, segment::bigint as cluster from clustered"))
def sessionize(spark, d):
    return episodes.sessionize(t.signal(spark, d), "subject_id", ["ts_us", "seq"], DAY).select("subject_id", "ts_us", "seq", "cluster")


@query(sql("limits", _FLAGGED + """, c as (select *, sum(g) over (partition by subject_id order by ts_us) as cluster from (select *, coalesce((ts_us - lag(ts_us) over (partition by subject_id order by ts_us) > 172800000000)::int, 0) as g from flagged)),
r as (select subject_id, ts_us, count(out) over w as n, 1 - avg(out::int) over w as frac_in from c window w as (partition by subject_id, cluster order by ts_us range between 431999999999 preceding and current row))
select subject_id, ts_us, n, round(frac_in, 6) as frac_in from r where n >= 4"""))
def rolling_fraction(spark, d):
    c = episodes.sessionize(_flagged(spark, d), "subject_id", ["ts_us"], 2 * DAY)
    return episodes.rolling_inside(c, ["subject_id", "cluster"], "ts_us", "out", 5 * DAY, 4).select("subject_id", "ts_us", "n", R("frac_in").alias("frac_in"))


@query(sql("limits", _FLAGGED + """, s as (select subject_id, min(ts_us) as z from flagged group by subject_id), k as (select (ts_us - z) // 86400000000 as step, count(*) filter (where out) as outside from flagged join s using (subject_id) group by 1),
g as (select unnest(range(min(step), max(step) + 1)) as step from k)
select g.step, coalesce(outside, 0) as outside, round(coalesce(outside, 0) / (select count(*) from s), 6) as outside_per_recording from g left join k using (step)"""))
def outside_by_elapsed_bucket(spark, d):
    f = _flagged(spark, d)
    start = f.groupBy("subject_id").agg(F.min("ts_us").alias("start_us"))
    return episodes.by_elapsed(f, start, "subject_id", "ts_us", "out", DAY).select("step", "outside", R("outside_per_recording").alias("outside_per_recording"))


@query(sql("limits", """r as (select subject_id, min(ts_us) as start_us, max(ts_us) as end_us from limits group by subject_id), f as (select subject_id, min(ts_us) as first from limits where lower is not null and upper is not null group by subject_id)
select subject_id, case when first < end_us then greatest(0, first - start_us) / 1e6 end as seconds_to_first from r left join f using (subject_id)"""))
def first_complete_label(spark, d):
    lim = t.limits(spark, d)
    rec = lim.groupBy("subject_id").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"))
    return episodes.time_to_first(lim, rec, "subject_id", ["lower", "upper"], "end_us")


@query(sql("limits", _FLAGGED + " select subject_id, (count(*) filter (where out)) * 1440 as minutes_outside from flagged group by subject_id"))
def minutes_outside(spark, d):
    return _flagged(spark, d).groupBy("subject_id").agg((F.count_if("out") * 1440).alias("minutes_outside"))


@query(sql("limits", _RUNS + " select subject_id, run, out, min(ts_us) as start_us, max(ts_us) as end_us, round(avg(mean), 6) as mean_value, round(median(mean), 6) as median_value from runs group by subject_id, run, out"))
def trajectory_by_run(spark, d):
    r = episodes.trajectories(_flagged(spark, d), "subject_id", ["ts_us"], "out", {"mean_value": R(F.avg("mean")), "median_value": R(F.median("mean"))})
    return r.select("subject_id", "run", "out", "start_us", "end_us", "mean_value", "median_value")


@query(sql("segments", "select subject_id, segment, length, coalesce(sum(length) over (partition by subject_id order by start_us rows between unbounded preceding and 1 preceding), 0)::bigint as offset, row_number() over (partition by subject_id order by start_us) - 1 as position from segments").replace("as offset", 'as "offset"'))
def sample_offsets(spark, d):
    s = windows.sample_offsets(t.segments(spark, d), "subject_id", "length")
    return windows.row_position(s, "subject_id", ["start_us"]).select("subject_id", "segment", "length", "offset", "position")


@query(sql("segments", """select subject_id, count(*) as segments, count(*) filter (where late) as overlaps from (select subject_id, end_us > lead(start_us) over (partition by subject_id order by start_us, segment) as late from segments) group by subject_id"""))
def segment_overlap_check(spark, d):
    return intervals.overlapping(t.segments(spark, d))


@query(sql("segments signal", """c as (select s.* from signal s), x as (
select 'time_given' as rule, count(*) filter (where ts_us is null or ts_us <= 0) as violations from c union all
select 'value_finite', count(*) filter (where value is null or isnan(value)) from c union all
select 'value_positive', count(*) filter (where value is null or not value > 0) from c union all
select 'not_an_error', count(*) filter (where variable = 'error') from c) select * from x"""))
def expectations(spark, d):
    return clean.expect(t.signal(spark, d), {"time_given": F.col("ts_us") > 0, "value_finite": F.col("value").isNotNull() & ~F.isnan("value"), "value_positive": F.col("value") > 0, "not_an_error": F.col("variable") != "error"})


def _cleaned(s):
    s = clean.implausible_to_null(clean.sentinel_to_null(s, "value", 50.0), "value", 5.0)
    s = s.where(F.col("value").isNull() | F.col("value").between(0, 90))
    stored = clean.null_to_sentinel(s.withColumn("stored", F.col("value")), "stored", -99999.0)
    return stored.select("subject_id", F.col("ts_us").cast("long").alias("ts_us"), R("stored").alias("stored"), R("value").alias("value"))


@query(sql("signal", """v as (select subject_id, ts_us, seq, case when nullif(value, 50) > 5 then nullif(value, 50) end as value from signal where variable != 'error')
select subject_id, ts_us::bigint as ts_us, round(coalesce(value, -99999), 6) as stored, round(value, 6) as value from v where value is null or value between 0 and 90"""))
def clean_signal(spark, d):
    return _cleaned(t.signal(spark, d).where("variable != 'error'"))


@query(sql("signal", """v as (select subject_id, ts_us, seq, case when nullif(value, 50) > 5 then nullif(value, 50) end as value from signal where variable != 'error')
select subject_id, ts_us::bigint as ts_us, round(coalesce(value, -99999), 6) as stored, round(value, 6) as value from v where value is null or value between 0 and 90"""))
def clean_signal_all(spark, d):
    """clean_signal by its former name."""
    return _cleaned(t.signal(spark, d).where("variable != 'error'"))


@query(sql("signal", "select count(*) filter (where abs(value) <= 1e-8) as near_zero, count(*) filter (where abs(value - 50) <= 1e-8 + 1e-5 * 50) as near_fifty from signal"))
def near_zero_count(spark, d):
    return t.signal(spark, d).agg(clean.near_equal_count("value").alias("near_zero"), clean.near_equal_count("value", 50.0).alias("near_fifty"))


@query(sql("signal", "select subject_id, ts_us // 86400000000 as day, " + ", ".join(f"min(value) filter (where variable = '{v}') as \"{v}\"" for v in ("click", "error", "purchase", "signup", "view")) + " from signal group by all"))
def pivot_by_time(spark, d):
    """Variables (a handful of kinds) as columns, by subject and day; subjects are too many for columns, see pivot_by_time_long."""
    s = t.signal(spark, d).withColumn("day", F.floor(F.col("ts_us") / DAY))
    return s.groupBy("subject_id", "day").pivot("variable").agg(F.min("value"))


@query(sql("signal", "select ts_us // 86400000000 as day, variable, subject_id, min(value) as value from signal group by all"))
def pivot_by_time_long(spark, d):
    """The pivot in long form, of all subjects and variables; columns would grow with the subjects."""
    return t.signal(spark, d).groupBy(F.floor(F.col("ts_us") / DAY).alias("day"), "variable", "subject_id").agg(F.min("value").alias("value"))


@query(sql("signal", "select subject_id, ts_us // 86400000000 as day, arg_min(value, (ts_us, seq)) as first_value from signal group by all"))
def first_by_time(spark, d):
    return t.signal(spark, d).groupBy("subject_id", F.floor(F.col("ts_us") / DAY).alias("day")).agg(F.min_by("value", F.struct("ts_us", "seq")).alias("first_value"))


@query(sql("limits segments", _FLAGGED + """, a as (select subject_id, avg(out::int) as share from flagged group by subject_id), b as (select subject_id, min(ts_us) as first from limits where lower is not null group by subject_id), c as (select subject_id, count(*) as segments from segments group by subject_id having count(*) > 5)
select a.subject_id, round(share, 6) as share_outside, first as first_limit_us, segments, case when hash_bucket < 2 then 'train' else 'test' end as split from (select *, (cast(subject_id as bigint) % 3) as hash_bucket from a) a join b using (subject_id) left join c using (subject_id)"""))
def subject_profile(spark, d):
    f = _flagged(spark, d)
    a = f.groupBy("subject_id").agg(F.avg(F.col("out").cast("int")).alias("share"))
    b = t.limits(spark, d).where("lower is not null").groupBy("subject_id").agg(F.min("ts_us").alias("first_limit_us"))
    c = t.segments(spark, d).groupBy("subject_id").agg(F.count("*").alias("segments")).where("segments > 5")
    split = a.select("subject_id", F.when(F.col("subject_id").cast("long") % 3 < 2, "train").otherwise("test").alias("split"))
    return a.join(b, "subject_id").join(c, "subject_id", "left").join(split, "subject_id").select("subject_id", R("share").alias("share_outside"), "first_limit_us", "segments", "split")


@query(sql("segments", """select subject_id, count(*) as parts, round(sum((end_us - start_us) / 1e6), 3) as seconds_with_gaps, round(sum(length / 0.5), 3) as seconds_without_gaps from segments group by subject_id"""))
def duration_by_part(spark, d):
    from tidemark.operators.stats import duration_by_part as op

    s = t.segments(spark, d).withColumns({"part": F.concat_ws("_", "subject_id", F.col("segment").cast("string")), "frequency": F.lit(0.5)})
    out = op(s, "part", F.split("part", "_")[0], "length", "frequency")
    return out.select(F.col("patient").alias("subject_id"), "parts", F.round("seconds_with_gaps", 3).alias("seconds_with_gaps"), F.round("seconds_without_gaps", 3).alias("seconds_without_gaps"))


@query(sql("segments", "select subject_id, count(*) as parts, list(segment order by segment)[1]::bigint as first_part from segments group by subject_id having count(*) > 1"))
def parts_per_subject(spark, d):
    p = t.segments(spark, d).groupBy("subject_id").agg(F.count("*").alias("parts"), F.min("segment").cast("long").alias("first_part"))
    return p.where("parts > 1")


@query(sql("segments", "p as (select subject_id, count(*) as n from segments group by subject_id) select subject_id || '_' || unnest(range(1, n + 1)) as part_id from p where n > 1 union select subject_id from p where n = 1"))
def expand_parts(spark, d):
    p = t.segments(spark, d).groupBy("subject_id").agg(F.count("*").alias("n"))
    many = p.where("n > 1").select("subject_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k")).select(F.concat_ws("_", "subject_id", F.col("k").cast("string")).alias("part_id"))
    return many.union(p.where("n = 1").select("subject_id")).distinct()
