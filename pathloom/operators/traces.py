"""Ordered evaluation traces: order, running quotas, time budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import layer_counts
from .records import DEPTH


def evaluation_trace(records: DataFrame) -> DataFrame:
    """(sample_id, evaluation_index, path, score) in temporal order; the root is index 0."""
    return records.select("sample_id", F.posexplode("evaluations").alias("evaluation_index", "e")).select("sample_id", "evaluation_index", F.col("e.path").alias("path"), F.col("e.score").alias("score"))


def quota_stop(trace: DataFrame, every: int, target: int) -> DataFrame:
    """(sample_id, stop_index, correct, wrong): the first check (each ``every`` new paths) at which both outcomes reached ``target``; null if never.

    The root doesn't count as a new path, but its outcome counts. One sample's trace is
    bounded by its search budget.
    """
    w = Window.partitionBy("sample_id").orderBy("evaluation_index").rowsBetween(Window.unboundedPreceding, 0)
    run = trace.withColumns({"correct": F.count_if(F.col("score") == 1.0).over(w), "wrong": F.count_if(F.col("score") == 0.0).over(w)})
    hit = (F.col("evaluation_index") > 0) & (F.col("evaluation_index") % every == 0) & (F.least("correct", "wrong") >= target)
    at = F.min_by(F.when(hit, F.struct(F.col("evaluation_index").alias("stop_index"), "correct", "wrong")), F.when(hit, F.col("evaluation_index")))
    return run.groupBy("sample_id").agg(at.alias("s")).select("sample_id", "s.stop_index", "s.correct", "s.wrong")


def time_budget(events: DataFrame, key: str, order: list[Column], seconds: Column, budget: float) -> DataFrame:
    """(key, n, used, stop_position): per key the events, their whole cost and the first 0-based position at which the running cost reaches ``budget``."""
    ordered = Window.partitionBy(key).orderBy(*order)
    rows = events.withColumns({"__pos": F.row_number().over(ordered) - 1, "__run": F.sum(seconds).over(ordered.rowsBetween(Window.unboundedPreceding, 0)), "__s": seconds})
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("__s"), 6).alias("used"), F.min(F.when(F.round("__run", 6) >= budget, F.col("__pos"))).alias("stop_position"))


def search_features(trace: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(sample_id, evaluation_index, score, counts): executions per layer of each evaluated path, the input of trajectory figures."""
    return trace.select("sample_id", "evaluation_index", "score", layer_counts(F.col("path"), depth).alias("counts"))
