"""Sources and sinks, written and read back; streaming forms."""

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tidemark.sources import sinks, tables
from tidemark.streaming import series


def test_limits_csv(spark, tmp_path):
    (tmp_path / "p7_updated.csv").write_text("DateTime,map_opt,lower,upper,r2\n45292.5,80,70,90,0.5\n45292.75,,70,,\n")
    out = tables.read_limits(spark, str(tmp_path)).orderBy("ts").collect()
    assert [(r.subject_id, str(r.ts), r.map_opt) for r in out] == [("p7", "2024-01-01 12:00:00", 80.0), ("p7", "2024-01-01 18:00:00", None)]


def test_demographics_and_listing(spark, tmp_path):
    (tmp_path / "d.csv").write_text("RedCapID,smoker\n1, \n2,yes\n")
    out = {r.RedCapID: r.smoker for r in tables.read_demographics(spark, str(tmp_path / "d.csv"), "RedCapID int, smoker string").collect()}
    assert out == {1: None, 2: "yes"}
    assert tables.list_files(spark, str(tmp_path), "*.csv").count() == 1


def test_recordings_and_segment_end(spark, tmp_path):
    spark.createDataFrame([("a", "123 seconds")], "subject_id string, duration string").write.parquet(str(tmp_path / "r"))
    assert tables.read_recordings(spark, str(tmp_path / "r")).first().duration_s == 123
    s = spark.createDataFrame([(0, 11, 2.0)], "start_us long, length long, frequency double")
    assert s.select(tables.segment_end().alias("e")).first().e == 5_000_000


def test_vectors_in_out_and_publish(spark, tmp_path):
    v = spark.createDataFrame([("train", "hr", 1, [1.0], False), ("test", "hr", 2, [2.0], True)], "split string, variable string, id int, x array<double>, invalid boolean")
    sinks.write_vectors(v, str(tmp_path / "v"))
    assert tables.read_variable(spark, str(tmp_path / "v"), "hr").count() == 1
    r = spark.createDataFrame([("mean", "a", 1), ("mean", "b", 2)], "mode string, subject_id string, n int")
    sinks.write_in_out(r, str(tmp_path / "io"))
    sinks.write_in_out(r.where("subject_id = 'a'").withColumn("n", F.lit(9)), str(tmp_path / "io"))
    assert sorted((x.subject_id, x.n) for x in spark.read.parquet(str(tmp_path / "io")).collect()) == [("a", 9), ("b", 2)]
    sinks.write_in_out(r.where("subject_id = 'a'"), str(tmp_path / "io"), exclusive=True)
    assert spark.read.parquet(str(tmp_path / "io")).count() == 1
    p = spark.createDataFrame([("x", 1), ("y", 2)], "artifact string, n int")
    sinks.publish(p, str(tmp_path / "p"))
    with pytest.raises(AnalysisException):
        sinks.publish(p, str(tmp_path / "p"))
    sinks.publish(p.where("artifact = 'x'").withColumn("n", F.lit(5)), str(tmp_path / "p"), overwrite=True)
    assert sorted((x.artifact, x.n) for x in spark.read.parquet(str(tmp_path / "p")).collect()) == [("x", 5), ("y", 2)]


def test_files_by_value_without_sorting(spark, tmp_path):
    """Sorting a task's rows by the value took memory in proportion to the rows."""
    sc, name = spark.sparkContext, "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    sc.setJobGroup("by value", "")
    try:
        sinks.write_by_value(spark.range(200_000).selectExpr("id", "id % 3 as v"), "v", str(tmp_path / "few"))
        jobs = sc.statusTracker().getJobIdsForGroup("by value")
        stages = [s for j in jobs for s in sc.statusTracker().getJobInfo(j).stageIds]
        assert stages and sum(sc._jsc.sc().statusStore().lastStageAttempt(s).peakExecutionMemory() for s in stages) < 1_000_000
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    sinks.write_by_value(spark.range(100).selectExpr("id", "id % 9 as v"), "v", str(tmp_path / "many"), files=1)
    for folder, n in (("few", 3), ("many", 9)):
        assert tables.list_files(spark, str(tmp_path / folder), "*.parquet").count() == n
    assert spark.read.parquet(str(tmp_path / "few")).where("id % 3 = v").count() == 200_000 and spark.conf.get(name) == before


def test_models_and_boards(spark, tmp_path):
    from tidemark.operators import models

    d = spark.createDataFrame([([float(i), 1.0], i % 2) for i in range(20)], "x array<double>, y int")
    m = models.estimator("tree").fit(models.prepared(d, "x", "y"))
    sinks.save_model(m, str(tmp_path / "m"))
    data = models.prepared(d, "x", "y")
    assert [r.yhat for r in models.scored(sinks.load_model(str(tmp_path / "m")), data).collect()] == [r.yhat for r in models.scored(m, data).collect()]
    c = models.confusion(models.scored(m, data), "y", "yhat")
    sinks.save_confusion(c, str(tmp_path / "c"), "pca")
    assert sinks.load_confusion(spark, str(tmp_path / "c"), "pca").count() == c.count()
    sinks.write_leaderboard(c, str(tmp_path / "l"), ["n"])
    assert spark.read.csv(str(tmp_path / "l"), header=True).count() == c.count()


def test_trials(spark, tmp_path):
    for run in ("models_main", "models_debug_main", "models_other"):
        f = tmp_path / "ds" / run / "forest"
        f.mkdir(parents=True)
        (f / "result.json").write_text("\n".join(json.dumps({"mean_val_auc": a, "done": b}) for a, b in ((0.7, True), (0.8, True), (0.9, False))))
    trials = tables.read_trials(spark, str(tmp_path), "main")
    assert sorted((r.run, r.model, r.debug, r.mean_val_auc) for r in trials.collect()) == [("models_debug_main", "forest", True, 0.7), ("models_debug_main", "forest", True, 0.8), ("models_main", "forest", False, 0.7), ("models_main", "forest", False, 0.8)]
    assert sorted((r.dataset, r.run, r.mean_val_auc, r.debug) for r in tables.best_trials(trials).collect()) == [("ds", "models_debug_main", 0.8, True), ("ds", "models_main", 0.8, False)]


def test_numerics_or_waves(spark):
    s = spark.createDataFrame([("a", "numerics/hr", 1), ("a", "waves/hr", 2), ("b", "waves/hr", 3), ("b", "numerics/abp", 4), ("c", "hr", 5)], "subject_id string, variable string, seq int")
    assert sorted((r.subject_id, r.variable, r.seq) for r in tables.best_form(s, "hr").collect()) == [("a", "hr", 1), ("b", "hr", 3), ("c", "hr", 5)]


def test_describe_table(spark):
    d = spark.createDataFrame([(1, None), (3, "x")], "a int, b string")
    assert sorted((r.column, r.nulls, r.least, r.most, r.rows) for r in tables.describe_table(d).collect()) == [("a", 0, "1", "3", 2), ("b", 1, "x", "x", 2)]


def test_streaming_equals_batch(spark, sf_dir, tmp_path):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("string").alias("subject_id"), F.col("ts").cast("timestamp").alias("ts"), "value", F.lit(20.0).alias("lower"), F.lit(80.0).alias("upper"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))
    out = series.outside_by_window(stream, "1 day", "40 days")
    q = out.writeStream.outputMode("complete").format("memory").queryName("windows").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.subject_id, r.start): (r.outside, r.samples) for r in spark.table("windows").collect()}
    want = {(r.subject_id, r.start): (r.outside, r.samples) for r in series.outside_by_window(e, "1 day").collect()}
    assert got == want and got


def test_streaming_sessions_in_batch(spark):
    e = spark.createDataFrame([("a", t, 1.0) for t in (0, 60, 200)], "subject_id string, s long, value double").withColumn("ts", F.timestamp_seconds("s"))
    assert sorted(r.n for r in series.sessions(e).collect()) == [1, 2]
    assert series.window_means(e, "1 minute").count() == 3
