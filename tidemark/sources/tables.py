"""Readers, and the domain views over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import DAY, duration_seconds, epoch_us, serial_day
from tidemark.operators import episodes

LIMITS_CSV = "DateTime double, map_opt double, lower double, upper double, r2 double"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_limits(spark: SparkSession, path: str, schema: str = LIMITS_CSV) -> DataFrame:
    """Limit tables `<subject>_updated.csv` with days since 1899-12-30, as (subject_id, ts, limits)."""
    raw = spark.read.csv(path, header=True, schema=schema).withColumn("_file", F.col("_metadata.file_path"))
    return raw.select(F.regexp_extract("_file", "([^/_]+)_updated", 1).alias("subject_id"), serial_day("DateTime").alias("ts"), *[c for c in raw.columns if c not in ("DateTime", "_file")])


def read_demographics(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with header; blank texts are missing."""
    raw = spark.read.csv(path, header=True, schema=schema, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    return raw.select(*[F.nullif(F.trim(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in raw.dtypes])


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """path, length of matching files; contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def read_recordings(spark: SparkSession, path: str) -> DataFrame:
    """Recording metadata with its duration text as seconds."""
    return spark.read.parquet(path).withColumn("duration_s", duration_seconds("duration"))


def read_variable(spark: SparkSession, path: str, variable: str, key: str = "subject_id") -> DataFrame:
    """One variable's samples: a recording's numerics, or its waves where it has no numerics.

    Variables are named `numerics/<name>`, `waves/<name>` or plainly; a table partitioned by variable is read
    in those partitions only.
    """
    return best_form(spark.read.parquet(path), variable, key)


def best_form(samples: DataFrame, variable: str, key: str = "subject_id") -> DataFrame:
    """Of each recording the samples of the first of numerics, waves and the plain name that it has."""
    if key not in samples.columns:  # no recordings to tell apart
        return samples.where(F.col("variable") == variable)
    forms = [f"numerics/{variable}", f"waves/{variable}", variable]
    rank = F.array_position(F.array(*map(F.lit, forms)), F.col("variable"))
    named = samples.where(F.col("variable").isin(forms)).withColumn("_form", rank)
    least = named.groupBy(key).agg(F.min("_form").alias("_least"))
    return named.join(least, key).where("_form = _least").drop("_form", "_least").withColumn("variable", F.lit(variable))


def segment_end(start: str = "start_us", length: str = "length", frequency: str = "frequency") -> Column:
    """When a segment's last sample lies."""
    return F.col(start) + ((F.col(length) - 1) / F.col(frequency) * 1e6).cast("long")


def read_trials(spark: SparkSession, path: str, run_name: str) -> DataFrame:
    """Finished JSON results under <dataset>/models[_debug]_<run>/<model>/ of runs whose folder holds run_name; debug says which kind."""
    raw = spark.read.option("recursiveFileLookup", "true").json(path).withColumn("_file", F.col("_metadata.file_path"))
    p = r"([^/]+)/([^/]+)/([^/]+)/[^/]*$"
    named = raw.withColumns({"dataset": F.regexp_extract("_file", p, 1), "run": F.regexp_extract("_file", p, 2), "model": F.regexp_extract("_file", p, 3)})
    done = named.where("done") if "done" in raw.columns else named.where("false")
    return done.where(F.col("run").contains(run_name)).withColumn("debug", F.col("run").contains("debug")).drop("_file")


def best_trials(trials: DataFrame, selector: str = "mean_val_auc") -> DataFrame:
    """The row with the highest selector of each dataset, run and model; of equal ones any, by the row's text."""
    key = ["dataset", "run", "model"]
    best = trials.groupBy(*key).agg(F.max_by(F.struct(*[F.col(c) for c in trials.columns if c not in key]), F.struct(F.col(selector), F.to_json(F.struct("*")))).alias("_b"))
    return best.select(*key, "_b.*")


def describe_table(df: DataFrame) -> DataFrame:
    """column, type, nulls, and extremes as text, of every column, in one pass."""
    counts = df.agg(F.count("*").alias("_n"), *[F.struct((F.count("*") - F.count(c)).alias("nulls"), F.min(c).cast("string").alias("least"), F.max(c).cast("string").alias("most")).alias(c) for c in df.columns])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(c)["nulls"].alias("nulls"), F.col(c)["least"].alias("least"), F.col(c)["most"].alias("most")) for c, t in df.dtypes])).alias("r")
    return counts.select("_n", rows).select("r.*", F.col("_n").alias("rows"))


# Views over the given tables


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as (subject_id, variable, ts_us, value, seq)."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").cast("string").alias("subject_id"), F.col("event_type").alias("variable"), epoch_us("ts").alias("ts_us"), "value", F.col("event_id").alias("seq"))


def daily(spark: SparkSession, sf_dir: str, by_variable: bool = False) -> DataFrame:
    """Means of subject-days (and variables): ts_us is the day's start."""
    keys = ["subject_id", *(["variable"] if by_variable else [])]
    g = signal(spark, sf_dir).groupBy(*keys, F.floor(F.col("ts_us") / DAY).alias("day"))
    return g.agg(F.avg("value").alias("mean"), F.count("*").alias("n")).withColumn("ts_us", F.col("day") * DAY)


def limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a subject-day: its mean, and limits from the seven days before (null where those say nothing)."""
    w = Window.partitionBy("subject_id").orderBy("day").rangeBetween(-7, -1)
    mid, width = F.avg("mean").over(w), 0.75 * F.stddev_samp("mean").over(w)
    return daily(spark, sf_dir).withColumns({"lower": mid - width, "upper": mid + width})


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with gaps of at most a day: key, segment, start_us, end_us, length."""
    s = episodes.sessionize(signal(spark, sf_dir), "subject_id", ["ts_us", "seq"], DAY, name="segment")
    return s.groupBy("subject_id", "segment").agg(F.min("ts_us").alias("start_us"), F.max("ts_us").alias("end_us"), F.count("*").alias("length"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change points: value 1 from an error on, 0 from the next other event on."""
    return signal(spark, sf_dir).select("subject_id", "ts_us", "seq", (F.col("variable") == "error").cast("int").alias("value"))


def trial_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(brand, type) as trials, with the mean discount and tax as metrics."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    line = table(spark, sf_dir, "lineitem").select("l_partkey", F.col("l_discount").cast("double").alias("d"), F.col("l_tax").cast("double").alias("t"))
    j = line.join(part, line["l_partkey"] == part["p_partkey"])
    return j.groupBy(F.col("p_brand").alias("brand"), F.col("p_type").alias("type")).agg(
        F.round(F.avg("d"), 9).alias("auc"), F.round(F.avg("t"), 9).alias("balanced_accuracy"), F.round(F.stddev_samp("d"), 9).alias("std_auc"), F.count("*").alias("n")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents: doc_id, score (length), y (quality)."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").cast("double").alias("score"))
    return d.join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """embeddings as (id, x, label)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), "label")


#: The same views in SQL, by name; each may use those before it.
SQL_VIEWS = {
    "signal": "select cast(user_id as varchar) as subject_id, event_type as variable, epoch_us(ts) as ts_us, value, event_id as seq from events",
    "daily": "select subject_id, ts_us // 86400000000 as day, avg(value) as mean, count(*) as n, (ts_us // 86400000000) * 86400000000 as ts_us from signal group by subject_id, ts_us // 86400000000",
    "limits": "select *, avg(mean) over w - 0.75 * stddev_samp(mean) over w as lower, avg(mean) over w + 0.75 * stddev_samp(mean) over w as upper from daily window w as (partition by subject_id order by day range between 7 preceding and 1 preceding)",
    "marked": "select *, coalesce((ts_us - lag(ts_us) over (partition by subject_id order by ts_us, seq) > 86400000000)::int, 0) as fresh from signal",
    "clustered": "select *, (sum(fresh) over (partition by subject_id order by ts_us, seq rows unbounded preceding))::bigint as segment from marked",
    "segments": "select subject_id, segment, min(ts_us) as start_us, max(ts_us) as end_us, count(*) as length from clustered group by subject_id, segment",
    "quality": "select subject_id, ts_us, seq, (variable = 'error')::int as value from signal",
    "bad": "select subject_id, start_us, end_us from (select subject_id, value, ts_us as start_us, coalesce(lead(ts_us) over (partition by subject_id order by ts_us), ts_us) as end_us from quality) where value != 0",
    "trial_results": "select p_brand as brand, p_type as type, round(avg(l_discount::double), 9) as auc, round(avg(l_tax::double), 9) as balanced_accuracy, round(stddev_samp(l_discount::double), 9) as std_auc, count(*) as n from lineitem join part on l_partkey = p_partkey group by all",
    "scores": "select doc_id, n_chars::double as score, quality as y from documents join labels using (doc_id)",
    "vectors": "select vec_id as id, embedding::double[] as x, label from embeddings",
}


def sql(names: str, query: str) -> str:
    """A statement with the named views in front."""
    wanted = names.split()
    needs = {"daily": ["signal"], "limits": ["signal", "daily"], "marked": ["signal"], "clustered": ["signal", "marked"], "segments": ["signal", "marked", "clustered"], "quality": ["signal"], "bad": ["signal", "quality"]}
    every = {n for w in wanted for n in [w, *needs.get(w, [])]}
    return "with " + ", ".join(f"{n} as ({SQL_VIEWS[n]})" for n in SQL_VIEWS if n in every) + (" " if query.lstrip().startswith("select") else ", ") + query
