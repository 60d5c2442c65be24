"""Decoded paths against known outcomes, and the decoder itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import _paths


def lookup_type(path: Column, valid: Column, invalid: Column) -> Column:
    """How a decoded path is scored: empty, valid_cache, invalid_cache (in that priority) or online."""
    has = lambda a: F.coalesce(F.array_contains(a, path), F.lit(False))
    return F.when(F.size(path) == 0, "empty").when(has(valid), "valid_cache").when(has(invalid), "invalid_cache").otherwise("online")


def looked_up(decoded: DataFrame, records: DataFrame) -> DataFrame:
    """``decoded``(sample_id, rank, path) with lookup_type and the score it implies; online paths have none yet.

    Paths of a record lie in its row, so one join on sample_id serves both lookups.
    """
    r = records.select("sample_id", _paths("final_valid_transitions").alias("v"), _paths("final_invalid_transitions").alias("i"))
    kind = lookup_type(F.col("path"), F.col("v"), F.col("i"))
    rows = decoded.join(r, "sample_id").select("sample_id", "rank", "path", kind.alias("lookup_type"))
    return rows.withColumn("score", F.when(F.col("lookup_type") == "valid_cache", 1.0).when(F.col("lookup_type").isin("invalid_cache", "empty"), 0.0))


def sample_results(looked: DataFrame, online_scores: DataFrame | None = None) -> DataFrame:
    """(sample_id, has_correct, correct_via_valid_cache, correct_via_online, n_online_paths, n_valid_cache_paths).

    ``online_scores``(sample_id, path, online_score) replays outside judgements; without it online paths count as wrong.
    """
    if online_scores is not None:
        looked = looked.join(online_scores, ["sample_id", "path"], "left").withColumn("score", F.coalesce("score", F.when(F.col("lookup_type") == "online", F.col("online_score"))))
    good = F.coalesce(F.col("score") == 1.0, F.lit(False))
    valid, online = F.col("lookup_type") == "valid_cache", F.col("lookup_type") == "online"
    return looked.groupBy("sample_id").agg(F.bool_or(good).alias("has_correct"), F.bool_or(valid).alias("correct_via_valid_cache"), F.bool_or(online & good).alias("correct_via_online"), F.count_if(online).alias("n_online_paths"), F.count_if(valid).alias("n_valid_cache_paths"))


def cache_breakdown(results: DataFrame) -> DataFrame:
    """One row: samples, correct ones and through which source; path counts cover samples with a correct path only."""
    v, o = F.col("correct_via_valid_cache"), F.col("correct_via_online")
    good = F.col("has_correct")
    n = lambda c, a: F.count_if(good & c).alias(a)
    return results.agg(
        F.count(F.lit(1)).alias("samples"), F.count_if(good).alias("correct_found"), F.round(F.count_if(good) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("correct_found_rate"),
        n(v, "via_valid"), n(o, "via_online"), n(v & o, "via_both"), n(v & ~o, "valid_only"), n(o & ~v, "online_only"),
        F.coalesce(F.sum(F.when(good, F.col("n_valid_cache_paths"))), F.lit(0)).alias("valid_path_hits"), F.coalesce(F.sum(F.when(good, F.col("n_online_paths"))), F.lit(0)).alias("online_paths"),
    )


#: Names of the operations in the order of their codes.
OPERATIONS = ("skip", "keep", "repeat")


def decode(seg: np.ndarray, ops: np.ndarray, threshold: float = 0.5, max_segment: int = 4, beam: int = 5, top_ops: int = 2) -> list[tuple[list[tuple[str, int, int]], float]]:
    """Beam search of one predictor output: boundaries where sigmoid(seg) reaches ``threshold``, at most ``max_segment`` layers a segment.

    Returns up to ``beam`` (segments, log probability), best first; equal scores keep their order.
    """
    depth = len(seg)
    starts = [0, *[i for i in range(1, depth) if 1 / (1 + np.exp(-seg[i])) >= threshold], depth]
    cuts = sorted({x for a, b in zip(starts[:-1], starts[1:], strict=True) for x in range(a, b, max_segment)})
    top = ops.max(axis=1, keepdims=True)
    logp = ops - top - np.log(np.exp(ops - top).sum(axis=1, keepdims=True))
    beams: list[tuple[list[tuple[str, int, int]], float]] = [([], 0.0)]
    for a, b in zip(cuts, [*cuts[1:], depth], strict=True):
        choice = sorted(range(3), key=lambda o: -logp[a, o])[:top_ops]
        grown = [([*seq, (OPERATIONS[o], b - a, int(o == 2))], score + float(logp[a, o])) for seq, score in beams for o in choice]
        beams = sorted(grown, key=lambda x: -x[1])[:beam]
    return beams


BEAM = "sample_id string, rank int, actions array<struct<action:string,size:int,count:int>>, score double"


def beam_search(logits: DataFrame, threshold: float = 0.5, max_segment: int = 4, beam: int = 5, top_ops: int = 2) -> DataFrame:
    """``logits``(sample_id, seg array<double>, ops array<array<double>>) -> ranked decoded programs per sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for i, seg, ops in zip(*(batch.column(c).to_pylist() for c in ("sample_id", "seg", "ops")), strict=True):
                for rank, (actions, score) in enumerate(decode(np.array(seg), np.array(ops), threshold, max_segment, beam, top_ops), 1):
                    out.append((i, rank, [{"action": a, "size": s, "count": c} for a, s, c in actions], score))
            kind = pa.list_(pa.struct([("action", pa.string()), ("size", pa.int32()), ("count", pa.int32())]))
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), kind, pa.float64()), strict=True)], names=["sample_id", "rank", "actions", "score"])

    return logits.select("sample_id", "seg", "ops").mapInArrow(run, BEAM)
