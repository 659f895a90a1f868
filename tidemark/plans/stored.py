"""Queries over sources and sinks: tables written in the library's formats and read back with its readers."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tidemark.functions import DAY, duration_seconds, renamed
from tidemark.operators import models, windows
from tidemark.sources import scratch, sinks
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


@query(sql("signal", """f as (select subject_id || '_' || (ts_us // 86400000000) as recording, variable, value, seq from signal where variable in ('view', 'click')),
h as (select recording, bool_or(variable = 'view') as numeric from f group by recording)
select recording, seq, round(value, 6) as value from f join h using (recording) where (variable = 'view') = numeric"""))
def numerics_else_waves(spark, d):
    """Views serve as a recording's numerics, clicks as its waves."""
    s = t.signal(spark, d).withColumn("recording", F.concat_ws("_", "subject_id", F.floor(F.col("ts_us") / DAY).cast("string")))
    s = s.withColumn("variable", renamed("variable", {"view": "numerics/abp", "click": "waves/abp"}))
    return t.best_form(s, "abp", "recording").select("recording", "seq", R("value").alias("value"))


@query(sql("segments", "select subject_id, segment, start_us + ((length - 1) / 0.5 * 1e6)::bigint as end_us from segments"))
def segment_ends(spark, d):
    """When the last sample of each segment lies, at half a sample a second."""
    return t.segments(spark, d).withColumn("frequency", F.lit(0.5)).select("subject_id", "segment", t.segment_end().alias("end_us"))


@query(sql("limits", "select subject_id, ts_us, round(lower, 6) as lower, round(upper, 6) as upper from limits"))
def limits_from_csv(spark, d):
    """Limits written one CSV a subject with serial dates, and read back."""
    path = scratch.folder(spark, "limits")
    rows = t.limits(spark, d).select("subject_id", (F.col("ts_us") / DAY + 25569).alias("DateTime"), F.col("mean").alias("map_opt"), "lower", "upper", F.lit(0.5).alias("r2"))
    rows.repartition("subject_id").write.partitionBy("subject_id").csv(path, header=True)
    back = spark.read.csv(path, header=True, schema=t.LIMITS_CSV + ", subject_id string")
    return back.select("subject_id", F.unix_micros(t.serial_day("DateTime")).alias("ts_us"), R("lower").alias("lower"), R("upper").alias("upper"))


@query("select c_custkey as RedCapID, case when c_custkey % 5 <> 0 then c_mktsegment end as segment, round(c_acctbal::double, 2) as balance from customer")
def demographics_from_csv(spark, d):
    """A CSV with blank texts for missing ones."""
    path = scratch.folder(spark, "demographics")
    c = t.table(spark, d, "customer")
    c.select(F.col("c_custkey").alias("RedCapID"), F.when(F.col("c_custkey") % 5 == 0, " ").otherwise(F.col("c_mktsegment")).alias("segment"), F.col("c_acctbal").cast("double").alias("balance")).write.csv(path, header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return t.read_demographics(spark, path, "RedCapID bigint, segment string, balance double").select("RedCapID", "segment", R("balance", 2).alias("balance"))


@query("select l_returnflag as flag, 1::bigint as files from lineitem group by 1")
def listed_files(spark, d):
    """Files by pattern, contents unread: one a value of the partition column."""
    path = scratch.folder(spark, "files")
    sinks.write_by_value(t.table(spark, d, "lineitem").select("l_returnflag", "l_orderkey"), "l_returnflag", path)
    found = t.list_files(spark, path, "*.parquet")
    return found.groupBy(F.regexp_extract("path", "l_returnflag=([^/]+)", 1).alias("flag")).agg(F.count("*").alias("files"))


@query(sql("segments", "select subject_id, segment, (end_us - start_us) // 1000000 as duration_s from segments"))
def recording_durations(spark, d):
    """Recordings whose duration is kept as text."""
    path = scratch.folder(spark, "recordings")
    s = t.segments(spark, d).select("subject_id", "segment", F.concat(F.floor((F.col("end_us") - F.col("start_us")) / 1_000_000).cast("string"), F.lit(" seconds")).alias("duration"))
    s.write.parquet(path)
    return t.read_recordings(spark, path).select("subject_id", "segment", "duration_s")


def _windows(spark, d):
    v = t.vectors(spark, d)
    return v.select("id", F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("v"), F.col("label").cast("string")).alias("variable"), "x", (F.col("id") % 7 == 0).alias("invalid"))


@query(sql("vectors", "select id, case when id % 5 = 0 then 'test' else 'train' end as split, 'v' || label as variable, round(list_sum(x), 6) as total from vectors where id % 7 <> 0"))
def stored_windows(spark, d):
    """The windows of all subjects by split and variable, invalid ones left out."""
    path = scratch.folder(spark, "windows")
    sinks.write_vectors(_windows(spark, d), path)
    return spark.read.parquet(path).select("id", "split", "variable", R(F.aggregate("x", F.lit(0.0), lambda s, v: s + v)).alias("total"))


@query(sql("limits", "select subject_id, 'mean' as mode, count(*) as days, case when subject_id::bigint % 2 = 0 then 2 else 1 end as run from limits group by subject_id"))
def overwritten_results(spark, d):
    """Results by mode and subject; a second run replaces the partitions it writes and no others."""
    path = scratch.folder(spark, "in_out")
    r = t.limits(spark, d).groupBy("subject_id").agg(F.count("*").alias("days")).withColumns({"mode": F.lit("mean"), "run": F.lit(1)}).repartition(4)
    sinks.write_in_out(r, path)
    sinks.write_in_out(r.where(F.col("subject_id").cast("long") % 2 == 0).withColumn("run", F.lit(2)), path)
    return spark.read.schema("days long, run int, mode string, subject_id string").parquet(path).select("subject_id", "mode", "days", "run")


@query("select o_orderpriority as artifact, count(*) as n, max(o_totalprice)::double as most from orders group by 1")
def published_artifacts(spark, d):
    """Artefacts published by name, then one of them again."""
    path = scratch.folder(spark, "published")
    a = t.table(spark, d, "orders").groupBy(F.substring("o_orderpriority", 1, 20).alias("artifact")).agg(F.count("*").alias("n"), F.max("o_totalprice").cast("double").alias("most"))
    sinks.publish(a.withColumn("n", F.when(F.col("artifact") != "1-URGENT", F.col("n")).otherwise(F.lit(0).cast("long"))), path)
    sinks.publish(a.where("artifact = '1-URGENT'"), path, overwrite=True)
    return spark.read.parquet(path).select("artifact", "n", "most")


@query(sql("limits", "select subject_id, 'mean' as mode, count(*) as days, case when subject_id::bigint % 2 = 0 then 2 else 1 end as run from limits group by subject_id"))
def versioned_results(spark, d):
    """S10 in versions that readers see whole: a second run replaces its own partitions."""
    path = scratch.folder(spark, "in_out")
    r = t.limits(spark, d).groupBy("subject_id").agg(F.count("*").alias("days")).withColumns({"mode": F.lit("mean"), "run": F.lit(1)}).repartition(4)
    sinks.publish_in_out(r, path)
    sinks.publish_in_out(r.where(F.col("subject_id").cast("long") % 2 == 0).withColumn("run", F.lit(2)), path)
    return sinks.read_published(spark, path).select("subject_id", "mode", "days", "run")


@query("select o_orderpriority as artifact, count(*) as n, max(o_totalprice)::double as most from orders group by 1")
def versioned_artifacts(spark, d):
    """S11 in versions: artefacts created once, then one of them replaced."""
    path = scratch.folder(spark, "published")
    a = t.table(spark, d, "orders").groupBy(F.substring("o_orderpriority", 1, 20).alias("artifact")).agg(F.count("*").alias("n"), F.max("o_totalprice").cast("double").alias("most"))
    sinks.publish_artifacts(a.withColumn("n", F.when(F.col("artifact") != "1-URGENT", F.col("n")).otherwise(F.lit(0).cast("long"))), path)
    sinks.publish_artifacts(a.where("artifact = '1-URGENT'"), path, overwrite=True)
    return sinks.read_published(spark, path).select("artifact", "n", "most")


@query(sql("vectors", "select count(*) as n, true as same from vectors"))
def stored_model(spark, d):
    """A fitted model saved, loaded and applied gives what it gave before."""
    v = t.vectors(spark, d).withColumn("y", (F.col("label") % 2).cast("int"))
    m = models.estimator("tree").fit(models.prepared(v, "x", "y"))
    path = scratch.folder(spark, "model")
    sinks.save_model(m, path)
    both = v.withColumn("_x", array_to_vector("x"))
    a, b = (models.scored(x, both).select("id", F.col("score").alias(n)) for x, n in ((m, "a"), (sinks.load_model(path), "b")))
    return a.join(b, "id").agg(F.count("*").alias("n"), F.bool_and(F.col("a") == F.col("b")).alias("same"))


@query(sql("trial_results", "select brand, type, auc from trial_results"))
def leaderboard_csv(spark, d):
    """A leaderboard as one CSV."""
    path = scratch.folder(spark, "board")
    sinks.write_leaderboard(t.trial_results(spark, d).select("brand", "type", "auc"), path, [F.col("auc").desc()])
    return spark.read.csv(path, header=True, schema="brand string, type string, auc double")


@query(sql("trial_results", "select 'models_main' as run, replace(brand, '#', '-') as model, max(auc) as mean_val_auc, false as debug from trial_results where n % 4 <> 0 group by brand"))
def finished_trials(spark, d):
    """Results in folders by data set, run and model; the best finished one of each model of a run."""
    path = scratch.folder(spark, "trials")
    r = t.trial_results(spark, d).select(F.lit("ds").alias("a"), F.translate("brand", "#", "-").alias("model"), F.col("auc").alias("mean_val_auc"), (F.col("n") % 4 != 0).alias("done"))
    for run in ("models_main", "models_other"):
        r.drop("a").repartition("model").withColumn("m", F.col("model")).write.partitionBy("m").json(f"{path}/ds/{run}")
    found = t.read_trials(spark, path, "main")
    return t.best_trials(found.drop("m")).select("run", F.regexp_replace("model", "^m=", "").alias("model"), "mean_val_auc", "debug")


@query(sql("vectors", "select id, round(x[9], 6) as first_step, round(x[16], 6) as last_step from vectors"))
def sliced_windows(spark, d):
    """Windows cut out of dense segments by sample index."""
    v = t.vectors(spark, d).select(F.col("id"), F.col("x").alias("samples"))
    cut = v.select("id", F.lit(8).alias("startidx"), F.lit(16).alias("endidx"))
    w = windows.slice_samples(v, cut, ["id"])
    return w.select("id", R(F.col("x")[0]).alias("first_step"), R(F.element_at("x", -1)).alias("last_step"))


@query("""select 'o_orderkey' as "column", 0::bigint as nulls, min(o_orderkey)::varchar as least, max(o_orderkey)::varchar as most, count(*) as rows from orders union all select 'o_orderpriority', count(*) - count(o_orderpriority), min(o_orderpriority), max(o_orderpriority), count(*) from orders""")
def described_table(spark, d):
    """Nulls and extremes of every column in one pass."""
    return t.describe_table(t.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")).select("column", "nulls", "least", "most", "rows")


@query(" union all ".join(f"""select '{c}' as "column", '{kind}' as type, count(*) - count({c}) as nulls, min({c})::varchar as least, max({c})::varchar as most, count(*) as rows from orders""" for c, kind in (("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"), ("o_orderdate", "timestamp_ntz"), ("o_orderpriority", "string"))))
def described_orders(spark, d):
    """S16 on a whole table: type, nulls and extremes of all its columns."""
    return t.describe_table(t.table(spark, d, "orders")).select("column", "type", "nulls", "least", "most", "rows")


@query("select l_orderkey, l_linenumber, case l_returnflag when 'A' then 'accepted' when 'R' then 'returned' else l_returnflag end as flag from lineitem")
def renamed_flags(spark, d):
    """Values renamed by a map; others stay."""
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", renamed("l_returnflag", {"A": "accepted", "R": "returned"}).alias("flag"))


@query("select o_orderkey, o_orderkey % 1000 as seconds from orders")
def duration_texts(spark, d):
    """The number in front of texts such as `123 seconds`."""
    text = F.concat((F.col("o_orderkey") % 1000).cast("string"), F.lit(" seconds"))
    return t.table(spark, d, "orders").withColumn("text", text).select("o_orderkey", duration_seconds("text").alias("seconds"))


@query("select l_orderkey, l_linenumber, floor(l_quantity::double * 1.1 + 1e-5)::bigint as low, ceil(l_quantity::double * 1.1 - 1e-5)::bigint as high from lineitem")
def tolerant_rounding(spark, d):
    """Floor and ceiling that forgive rounding errors."""
    from tidemark.functions import tolerant_ceil, tolerant_floor

    v = F.col("l_quantity").cast("double") * 1.1
    return t.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", tolerant_floor(v).cast("long").alias("low"), tolerant_ceil(v).cast("long").alias("high"))
