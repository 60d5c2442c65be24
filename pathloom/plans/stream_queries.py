"""Registered queries of the streaming operators, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..runtime import table
from ..streaming import resume


def stream_once_per_sample(spark, sf_dir):
    schema = table(spark, sf_dir, "search_record").schema
    stream = resume.record_stream(spark, f"{sf_dir}/search_record.parquet", schema).filter("written_at is not null")
    once = resume.drained(resume.once_per_sample(stream, delay="400 days").select("sample_id", "split"), "once")
    return once.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def stream_window_counts(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    counts = resume.windowed_counts(resume.record_stream(spark, f"{sf_dir}/events.parquet", schema), "ts", "1 day", "2 days", "event_type")
    return resume.drained(counts, "windows", "complete").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n")


QUERIES = (stream_once_per_sample, stream_window_counts)

SQL = {
    "stream_once_per_sample": "SELECT split, count(DISTINCT sample_id) AS n FROM search_record WHERE written_at IS NOT NULL GROUP BY 1",
    "stream_window_counts": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY 1, 2",
}
