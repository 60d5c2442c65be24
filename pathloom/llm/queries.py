"""The registered queries of the eight training-data problems and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table, written
from . import copies, groups, leakage, neardup, oracle, packing, sampling, spam, unify


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.cross_split_pairs(neardup.split_sides(table(spark, sf_dir, "manifest")))


def p1_overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.overlap_report(table(spark, sf_dir, "manifest"), p1_found(spark, sf_dir))


def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.questions(table(spark, sf_dir, "raw_question"), table(spark, sf_dir, "manifest"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_questions(spark, sf_dir))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groups.near_duplicate_groups(_questions(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unify.hidden_twins(_questions(spark, sf_dir))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.records(*(table(spark, sf_dir, t) for t in ("raw_question", "manifest", "raw_line")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies.copy_pairs(_records(spark, sf_dir))


def p5_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = written(copies.canonical_hashes(_records(spark, sf_dir)), "hashes")
    return copies.collapsed(hashes, repeated=("manifest",))  # raw_id and line_id are unique


#: Sampling rates of an earlier sample and of this one, by split and difficulty; other strata take the default.
EARLIER_RATES = sampling.Rates({"train|5": 0.15, "validation|3": 0.2}, 0.05)
RATES = sampling.Rates({"train|1": 0.05, "train|5": 0.2, "validation|3": 0.5, "test|5": 0.25}, 0.1)
STRATA = ["split", "difficulty"]


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = sampling.stable_sample(table(spark, sf_dir, "manifest"), "sample_id", STRATA, RATES, before=EARLIER_RATES)
    return picked.select("sample_id", "global_index", "split", "difficulty", "prepared_at")


def p3_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.growth_replay(table(spark, sf_dir, "manifest"), "sample_id", "prepared_at", STRATA, RATES)


def _placed(spark: SparkSession, sf_dir: str, capacity: int) -> DataFrame:
    return packing.containers(packing.token_counts(table(spark, sf_dir, "documents")), capacity)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, 2048)


def p6_containers_512(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _placed(spark, sf_dir, 512)


def p6_fill_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(packing.token_counts(table(spark, sf_dir, "documents")), "counts")
    reports = [packing.fill_report(packing.containers(counts, c), c) for c in (512, 2048)]
    return reports[0].union(reports[1])


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item"))


def p7_item_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, documents = table(spark, sf_dir, "heldout_item"), table(spark, sf_dir, "documents")
    exact, near = leakage.leaks_and_near(documents, items)
    return leakage.leak_report(exact, items, near)


def p7_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.near_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "heldout_item"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"))


def p8_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_scores(table(spark, sf_dir, "documents"))


_ALL = (p1_found, p1_overlap_report, p2_found, p2_groups, p3_sample, p3_growth, p4_found, p5_found, p5_collapsed, p6_containers, p6_containers_512, p6_fill_report, p7_found, p7_item_report, p7_proximity, p8_found, p8_scores)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


_FRACTION = "('0x' || substr(sha256('sample|' || sample_id), 1, 13))::BIGINT / 4503599627370496.0"
_STRATUM = "coalesce(split, '') || '|' || coalesce(difficulty::VARCHAR, '')"
_RATE = f"CASE {_STRATUM} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in RATES.named.items()) + f" ELSE {RATES.default} END"


def oracle_sql() -> dict[str, str]:
    hit = f"{_FRACTION} < {_RATE}"
    return oracle.oracle_sql() | {
        "p3_sample": f"""
            SELECT sample_id, global_index, split, difficulty, prepared_at FROM manifest
            WHERE sample_id IN (SELECT sample_id FROM manifest WHERE sample_id IS NOT NULL AND {hit})""",
        "p3_growth": f"""
            WITH rec AS (SELECT sample_id, min(strftime(prepared_at, '%Y-%m')) AS first_month,
                                min(CASE WHEN {hit} THEN strftime(prepared_at, '%Y-%m') END) AS hit_from
                         FROM manifest WHERE sample_id IS NOT NULL AND prepared_at IS NOT NULL GROUP BY 1),
                 months AS (SELECT DISTINCT first_month AS month FROM rec UNION SELECT DISTINCT hit_from FROM rec WHERE hit_from IS NOT NULL)
            SELECT month,
                   (SELECT count(*) FROM rec WHERE first_month <= month)::BIGINT AS records,
                   (SELECT count(*) FROM rec WHERE hit_from <= month)::BIGINT AS chosen,
                   (SELECT count(*) FROM rec WHERE hit_from < month)::BIGINT AS kept
            FROM months""",
    }
