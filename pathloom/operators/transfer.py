"""How frozen candidate paths transfer to held-out questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import digest_of
from ..functions.paths import KEEP, layer_actions
from .ranking import first_by
from .records import DEPTH

ROUND = 6


def held_out(universal_record: DataFrame) -> DataFrame:
    """Complete held-out records (sample_id, split, difficulty, baseline_score, scores), exact repeats once."""
    keep = ["sample_id", "split", "difficulty", "baseline_score", "scores"]
    return first_by(universal_record.filter("status = 'complete'"), ["sample_id"], F.col("record_digest"), keep=keep)


def long_scores(held: DataFrame) -> DataFrame:
    """(sample_id, split, difficulty, baseline, candidate_id, score): one row per question and candidate."""
    return held.select("sample_id", "split", "difficulty", F.col("baseline_score").alias("baseline"), F.explode("scores").alias("candidate_id", "score"))


def by_difficulty(scores: DataFrame) -> DataFrame:
    """(candidate_id, split, difficulty, questions, baseline_sum, program_sum, wrong_to_correct, correct_to_wrong, accuracies, gain)."""
    per = scores.groupBy("candidate_id", "split", "difficulty").agg(
        F.count(F.lit(1)).alias("questions"), F.sum("baseline").alias("baseline_sum"), F.sum("score").alias("program_sum"),
        F.count_if((F.col("baseline") == 0) & (F.col("score") == 1)).alias("wrong_to_correct"), F.count_if((F.col("baseline") == 1) & (F.col("score") == 0)).alias("correct_to_wrong"),
    )
    return per.withColumns({"baseline_accuracy": F.col("baseline_sum") / F.col("questions"), "program_accuracy": F.col("program_sum") / F.col("questions"), "gain": (F.col("program_sum") - F.col("baseline_sum")) / F.col("questions")})


def metrics(scores: DataFrame) -> DataFrame:
    """One row per candidate and split: accuracies, gain, flips, mean and worst gain over difficulties.

    Two levels of aggregation; the second works on a few rows per candidate.
    """
    n = F.sum("questions")
    out = by_difficulty(scores).groupBy("candidate_id", "split").agg(
        n.alias("questions"), (F.sum("baseline_sum") / n).alias("baseline_accuracy"), (F.sum("program_sum") / n).alias("program_accuracy"),
        ((F.sum("program_sum") - F.sum("baseline_sum")) / n).alias("gain"), F.sum("wrong_to_correct").alias("wrong_to_correct"), F.sum("correct_to_wrong").alias("correct_to_wrong"),
        (F.sum("wrong_to_correct") - F.sum("correct_to_wrong")).alias("net_corrections"), F.avg("gain").alias("macro_gain"), F.min("gain").alias("worst_group_gain"),
    )
    return rounded(out, "baseline_accuracy", "program_accuracy", "gain", "macro_gain", "worst_group_gain")


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, ROUND) for c in columns})


def shared_difficulties(scores: DataFrame) -> DataFrame:
    """Scores of the difficulties that both held-out splits have."""
    both = scores.groupBy("difficulty").agg(F.count_distinct("split").alias("n")).filter("n = 2").select("difficulty")
    return scores.join(both, "difficulty", "left_semi")


def selected(measured: DataFrame, candidates: DataFrame) -> DataFrame:
    """The candidate chosen on validation: worst-group gain, macro gain, accuracy, shorter length, greater id; with its test values."""
    m = measured.join(candidates.select("candidate_id", "length"), "candidate_id")
    order = F.struct("worst_group_gain", "macro_gain", "program_accuracy", (-F.col("length")).alias("short"), "candidate_id")
    best = m.filter("split = 'validation'").agg(F.max_by("candidate_id", order).alias("candidate_id"))
    pick = m.join(best, "candidate_id", "left_semi")
    value = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    return pick.groupBy("candidate_id", "length").agg(*[value(c, s) for s in ("validation", "test") for c in ("gain", "macro_gain", "worst_group_gain", "program_accuracy")])


def selected_by_difficulty(per: DataFrame, candidates: DataFrame) -> DataFrame:
    """For each difficulty the candidate with the best validation gain, then accuracy, shorter length, greater id; with its test gain."""
    p = rounded(per, "gain", "program_accuracy").join(candidates.select("candidate_id", "length"), "candidate_id")
    order = F.struct("gain", "program_accuracy", (-F.col("length")).alias("short"), "candidate_id")
    best = p.filter("split = 'validation'").groupBy("difficulty").agg(F.max_by(F.struct("candidate_id", F.col("gain").alias("validation_gain")), order).alias("b")).select("difficulty", "b.*")
    test = p.filter("split = 'test'").select("difficulty", "candidate_id", F.col("gain").alias("test_gain"))
    return best.join(test, ["difficulty", "candidate_id"], "left")


def bootstrap(scores: DataFrame, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """(split, candidate_id, gain_low, gain_high): paired 95 % bootstrap interval of the mean gain of each candidate in ``scores``.

    A draw needs only how many deltas are -1, 0 and 1, since resampling from sorted deltas is
    the same. Draws come from a hash of (seed, split, resample, draw), so they are
    reproducible anywhere; the interval takes the values at int(q * (resamples - 1)).
    """
    delta = F.col("score") - F.col("baseline")
    n = scores.groupBy("split", "candidate_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(delta < 0).alias("worse"), F.count_if(delta > 0).alias("better"))
    draws = n.select("*", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))).alias("b")).select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    h = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(str(seed)), "split", F.col("b").cast("string"), F.col("i").cast("string")), 256), 1, 13), 16, 10).cast("bigint")
    at = F.pmod(h, F.col("n"))
    value = F.when(at < F.col("worse"), -1).when(at >= F.col("n") - F.col("better"), 1).otherwise(0)
    means = draws.groupBy("split", "candidate_id", "b").agg((F.sum(value) / F.count(F.lit(1))).alias("m"))
    sorted_ = means.groupBy("split", "candidate_id").agg(F.array_sort(F.collect_list("m")).alias("ms"))
    pick = lambda q: F.round(F.element_at("ms", F.lit(int(q * (resamples - 1)) + 1)), ROUND)
    return sorted_.select("split", "candidate_id", pick(0.025).alias("gain_low"), pick(0.975).alias("gain_high"))


def bootstrap_counts(scores: DataFrame, resamples: int = 10_000, seed: int = 42) -> DataFrame:
    """``bootstrap`` for any number of questions: each resample draws how many deltas are -1 and 1 at once, from the counts of all.

    The draws are those of resampling n questions with replacement, made by a generator that
    is seeded with (seed, split); nothing grows with the number of questions.
    """
    delta = F.col("score") - F.col("baseline")
    counts = scores.groupBy("split", "candidate_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(delta < 0).alias("worse"), F.count_if(delta > 0).alias("better"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low, high = [], []
            for split, n, worse, better in zip(*(batch.column(c).to_pylist() for c in ("split", "n", "worse", "better")), strict=True):
                rng = np.random.Generator(np.random.PCG64(int(digest_of([seed, split])[:16], 16)))
                drawn = rng.multinomial(n, [worse / n, better / n, (n - worse - better) / n], size=resamples)
                means = np.sort((drawn[:, 1] - drawn[:, 0]) / n)
                low.append(round(float(means[int(0.025 * (resamples - 1))]), ROUND))
                high.append(round(float(means[int(0.975 * (resamples - 1))]), ROUND))
            yield pa.RecordBatch.from_arrays([batch.column("split"), batch.column("candidate_id"), pa.array(low, pa.float64()), pa.array(high, pa.float64())], names=["split", "candidate_id", "gain_low", "gain_high"])

    return counts.mapInArrow(run, "split string, candidate_id string, gain_low double, gain_high double")


def verdict(chosen: DataFrame, interval: DataFrame) -> DataFrame:
    """(candidate_id, validation_robust, held_out_robust, test_interval_excludes_zero)."""
    low = interval.filter("split = 'test'").select("candidate_id", "gain_low")
    val = (F.col("validation_gain") > 0) & (F.col("validation_worst_group_gain") >= 0)
    test = (F.col("test_gain") > 0) & (F.col("test_worst_group_gain") >= 0)
    return chosen.join(low, "candidate_id", "left").select("candidate_id", val.alias("validation_robust"), (val & test).alias("held_out_robust"), (F.col("gain_low") > 0).alias("test_interval_excludes_zero"))


def single_layer_transfer(measured: DataFrame, candidates: DataFrame, depth: int = DEPTH) -> DataFrame:
    """Candidates with exactly one edited layer, ranked by validation only; test values are reports."""
    acts = layer_actions(F.col("path"), depth)
    edits = candidates.select("candidate_id", F.filter(F.transform(acts, lambda a, i: F.struct(a.alias("action"), i.alias("layer"))), lambda e: e["action"] != KEEP).alias("e")).filter(F.size("e") == 1)
    one = edits.select("candidate_id", F.col("e")[0]["layer"].alias("layer"), F.col("e")[0]["action"].alias("action"))
    value = lambda c, s: F.max(F.when(F.col("split") == s, F.col(c))).alias(f"{s}_{c}")
    wide = measured.groupBy("candidate_id").agg(value("worst_group_gain", "validation"), value("macro_gain", "validation"), value("gain", "test"), value("worst_group_gain", "test"))
    w = Window.orderBy(F.desc("validation_worst_group_gain"), F.desc("validation_macro_gain"), "action", "layer", "candidate_id")
    return one.join(wide, "candidate_id").withColumn("rank", F.row_number().over(w))


def split_counts(held: DataFrame) -> DataFrame:
    """Questions per split and difficulty, zero-filled."""
    return held.groupBy("split").pivot("difficulty", [1, 2, 3, 4, 5]).agg(F.count(F.lit(1))).na.fill(0).select("split", *[F.col(str(d)).alias(f"d{d}") for d in range(1, 6)])


def with_search_baseline(held: DataFrame, searched: DataFrame) -> DataFrame:
    """(sample_id, split, baseline_score, search_score, agrees): held-out baselines beside those the search measured, if any."""
    s = searched.select("sample_id", F.col("initial_score").alias("search_score"))
    return held.join(s, "sample_id", "left").select("sample_id", "split", "baseline_score", "search_score", F.col("baseline_score").eqNullSafe(F.col("search_score")).alias("agrees"))


def group_accuracy(scores: DataFrame) -> DataFrame:
    """(kind, value, candidate_id, questions, accuracy, accuracy_gain) by difficulty and by split in one pass over GROUPING SETS."""
    df = scores.withColumn("d", F.col("difficulty").cast("string"))
    grouped = df.sparkSession.sql(
        "SELECT candidate_id, d, split, count(1) AS questions, avg(score) AS accuracy, avg(baseline) AS base FROM {scores} GROUP BY GROUPING SETS ((candidate_id, d), (candidate_id, split))",
        scores=df,
    )
    kind = F.when(F.col("d").isNotNull(), "difficulty").otherwise("split")
    out = grouped.select(kind.alias("kind"), F.coalesce("d", "split").alias("value"), "candidate_id", "questions", "accuracy", (F.col("accuracy") - F.col("base")).alias("accuracy_gain"))
    return rounded(out, "accuracy", "accuracy_gain")


def outcome_transitions(scores: DataFrame) -> DataFrame:
    """(candidate_id, from_outcome, to_outcome, n): the 2x2 matrix of baseline to program outcomes; missing scores are "pending" and in no transition."""
    name = lambda c: F.when(F.col(c) == 1, "correct").when(F.col(c) == 0, "wrong")
    return scores.groupBy("candidate_id", name("baseline").alias("from_outcome"), name("score").alias("to_outcome")).agg(F.count(F.lit(1)).alias("n")).filter("from_outcome is not null and to_outcome is not null")

