"""Programs for representation capture, slot-by-slot alignment, and re-evaluation of selected paths."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.paths import full_path, seeded_digest
from .geometry import unit
from .records import DEPTH
from .transfer import by_difficulty, metrics, selected, selected_by_difficulty


def capture_programs(scores: DataFrame, candidates: DataFrame, most: int = 8, depth: int = DEPTH) -> DataFrame:
    """(program_id, path, source, length, place): the full path, then the selected, the per-difficulty selected and the best ranked candidates, up to ``most``."""
    c = candidates.select("candidate_id", "path", "length")
    m = metrics(scores)
    best = selected(m, candidates).select("candidate_id", F.struct(F.lit(0).alias("stage"), F.lit(0).alias("n")).alias("seq"), F.lit("universal_validation_selected").alias("source"))
    per = selected_by_difficulty(by_difficulty(scores), candidates).select("candidate_id", F.struct(F.lit(1).alias("stage"), F.col("difficulty").alias("n")).alias("seq"), F.concat(F.lit("difficulty_"), F.col("difficulty").cast("string"), F.lit("_validation_selected")).alias("source"))
    rest = m.filter("split = 'validation'").select("candidate_id", F.struct(F.lit(2).alias("stage"), F.lit(0).alias("n")).alias("seq"), F.lit("validation_ranked_fill").alias("source"))
    first = best.union(per).union(rest).groupBy("candidate_id").agg(F.min(F.struct("seq", "source")).alias("s"))
    order = m.filter("split = 'validation'").select("candidate_id", (-F.col("worst_group_gain")).alias("w"), (-F.col("macro_gain")).alias("g"))
    rows = first.join(c, "candidate_id").join(order, "candidate_id").orderBy("s.seq", "w", "g", "length", "candidate_id").limit(max(0, most - 1))
    listed = rows.agg(F.array_sort(F.collect_list(F.struct("s.seq", "w", "g", "length", "candidate_id", "path", F.col("s.source").alias("source")))).alias("x"))
    flat = listed.select(F.posexplode("x").alias("p", "x")).select(F.col("x.candidate_id").alias("program_id"), F.col("x.path").alias("path"), F.col("x.source").alias("source"), F.col("x.length").alias("length"), (F.col("p") + 1).alias("place"))
    base = candidates.sparkSession.range(1).select(F.lit("baseline").alias("program_id"), full_path(depth).alias("path"), F.lit("full_depth").alias("source"), F.lit(depth).alias("length"), F.lit(0).alias("place"))
    return base.union(flat)


def slot_neighbours(vectors: DataFrame, k: int, alignment_samples: int = 500, seed: int = 42) -> DataFrame:
    """(program_id, slot, sample_id, neighbours): k nearest samples per program and slot among the first ``alignment_samples`` by content hash.

    ``vectors`` has (program_id, slot, sample_id, vec). The sample size is a parameter of the
    report, so a group of (program, slot) is bounded.
    """
    chosen = vectors.select("sample_id").distinct().orderBy(seeded_digest(seed, F.col("sample_id"))).limit(alignment_samples)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("sample_id")
        ids, x = pdf["sample_id"].to_numpy(), unit(np.stack(pdf["vec"]).astype(np.float64))
        sim = np.round(x @ x.T, 6)
        np.fill_diagonal(sim, -np.inf)
        order = np.argsort(-sim, axis=1, kind="stable")[:, :k]
        return pd.DataFrame({"program_id": pdf["program_id"].iloc[0], "slot": pdf["slot"].iloc[0], "sample_id": ids, "neighbours": [ids[o].tolist() for o in order]})

    return vectors.join(F.broadcast(chosen), "sample_id", "left_semi").groupBy("program_id", "slot").applyInPandas(run, "program_id string, slot int, sample_id string, neighbours array<string>")


def layerwise_overlap(neighbours: DataFrame, k: int, baseline: str = "baseline") -> DataFrame:
    """(program_id, slot, base_slot, overlap): mean share of common neighbours of each slot with each slot of the baseline."""
    base = neighbours.filter(F.col("program_id") == baseline).select("sample_id", F.col("slot").alias("base_slot"), F.col("neighbours").alias("base"))
    both = neighbours.join(base, "sample_id")
    return both.groupBy("program_id", "slot", "base_slot").agg(F.round(F.avg(F.size(F.array_intersect("neighbours", "base")) / F.lit(k)), 6).alias("overlap"))


def selection_errors(selected_paths: DataFrame, results: DataFrame) -> DataFrame:
    """(candidate_id, problem): selected paths that are reused, unknown, or differ in path or label from the search results."""
    again = selected_paths.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("candidate_id", F.lit("reused").alias("problem"))
    r = results.select("candidate_id", F.col("path").alias("r_path"), F.col("correct").alias("r_correct"), F.lit(True).alias("known"))
    j = selected_paths.join(r, "candidate_id", "left")
    kind = F.when(F.col("known").isNull(), "unknown").when(~F.col("path").eqNullSafe(F.col("r_path")), "other_path").when(~F.col("correct").eqNullSafe(F.col("r_correct")), "other_label")
    return again.union(j.select("candidate_id", kind.alias("problem")).filter("problem is not null"))


def thinking_table(selected_paths: DataFrame, results: DataFrame) -> DataFrame:
    """One row per selected path (figure, pair_index, role): its new outcome, or pending, with token counts."""
    r = results.select("candidate_id", "outcome", "extracted_answer", "status", "thinking_tokens", "answer_tokens", "generated_tokens", "hit_token_limit")
    return selected_paths.join(r, "candidate_id", "left").select(
        "figure", "pair_index", F.when(F.col("correct"), "C").otherwise("W").alias("role"), "candidate_id", "correct", F.coalesce("outcome", F.lit("pending")).alias("outcome"), "extracted_answer", "status", "thinking_tokens", "answer_tokens", "generated_tokens", "hit_token_limit",
    )


def thinking_summary(table: DataFrame) -> DataFrame:
    """One row: outcome counts and the 2x2 transitions; truncated and pending paths are in no transition."""
    n = lambda c, a: F.count_if(c).alias(a)
    o, good = F.col("outcome"), F.col("correct")
    return table.agg(
        *[n(o == x, x) for x in ("correct", "wrong", "truncated", "pending")],
        n(good & (o == "correct"), "correct_to_correct"), n(good & (o == "wrong"), "correct_to_wrong"), n(~good & (o == "correct"), "wrong_to_correct"), n(~good & (o == "wrong"), "wrong_to_wrong"),
    )
