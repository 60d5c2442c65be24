import datetime as dt

from pathloom.streaming import resume


def _write(spark, rows, path):
    spark.createDataFrame(rows, "sample_id string, score double, written_at timestamp").coalesce(1).write.mode("append").parquet(path)


def test_each_sample_once_over_restarts(spark, tmp_path):
    path, mark = str(tmp_path / "in"), str(tmp_path / "mark")
    t = dt.datetime(2025, 1, 1)
    _write(spark, [("a", 1.0, t), ("b", 0.0, t)], path)
    schema = spark.read.parquet(path).schema
    stream = lambda: resume.once_per_sample(resume.record_stream(spark, path, schema))
    out = str(tmp_path / "out")
    run = lambda: stream().writeStream.format("parquet").option("checkpointLocation", mark).trigger(availableNow=True).start(out).awaitTermination()
    run()
    _write(spark, [("a", 1.0, t + dt.timedelta(days=50)), ("c", 1.0, t + dt.timedelta(days=1))], path)
    run()
    assert sorted(r.sample_id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]


def test_windows_and_quota(spark, tmp_path):
    path = str(tmp_path / "in")
    t = dt.datetime(2025, 1, 1)
    _write(spark, [("a", float(i % 2), t + dt.timedelta(minutes=i)) for i in range(30)], path)
    schema = spark.read.parquet(path).schema
    w = resume.drain(resume.windowed_counts(resume.record_stream(spark, path, schema), "written_at", "10 minutes", "5 minutes", "sample_id"), "win", str(tmp_path / "m1"), "complete")
    assert sorted(r.n for r in w.collect()) == [10, 10, 10]
    whole = resume.drained(resume.windowed_counts(resume.record_stream(spark, path, schema), "written_at", "10 minutes", "5 minutes", "sample_id"), "windows", "complete")
    assert sorted(map(str, whole.collect())) == sorted(map(str, w.collect()))
    none = resume.drained(resume.windowed_counts(resume.record_stream(spark, path, schema).filter("score > 5"), "written_at", "10 minutes", "5 minutes", "sample_id"), "windows", "complete")
    assert none.count() == 0
    q = resume.drain(resume.running_quota(resume.record_stream(spark, path, schema), 15), "quota", str(tmp_path / "m2"), "update")
    last = q.collect()[-1]
    assert (last.seen, last.correct, last.wrong, last.reached) == (30, 15, 15, True)
