"""From raw questions to a manifest: validation, duplicates, conflicts, content order, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import has_text, question_identity
from ..functions.paths import seeded_digest
from .ranking import first_by, numbered

DIFFICULTIES = (1, 2, 3, 4, 5)


def reject_reason(query: Column, gt_ans: Column, level: Column, query4test: Column) -> Column:
    """Why a raw row can't be used, or null. A row counts as held-out unless query4test is literally false."""
    return (
        F.when(~has_text(query) | ~has_text(gt_ans), "missing_text")
        .when(~F.coalesce(level.between(1, 5), F.lit(False)), "bad_level")
        .when(~F.coalesce(query4test == F.lit(False), F.lit(False)), "test_source")
    )


def raw_rows(raw_question: DataFrame) -> DataFrame:
    """The used columns of the raw table, flat, with the reject reason."""
    level = F.col("query_metadata.level")
    return raw_question.select("raw_id", "query", "gt_ans", level.alias("level"), "query_id", "query4test", reject_reason(F.col("query"), F.col("gt_ans"), level, F.col("query4test")).alias("reason"))


def reject_counts(raw: DataFrame) -> DataFrame:
    """(reason, n): rows by reject reason, accepted ones as "accepted"."""
    return raw.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def accepted(raw: DataFrame) -> DataFrame:
    return raw.filter("reason is null").drop("reason")


def unique_questions(rows: DataFrame, key: Column, last: bool = False) -> DataFrame:
    """One row per question key: the first by raw_id, or the last."""
    return first_by(rows.withColumn("key", key), ["key"], F.col("raw_id"), last)


def answer_conflicts(rows: DataFrame, key: Column) -> DataFrame:
    """(key, n_rows, n_variants): questions whose copies disagree on answer or level."""
    variant = F.struct("gt_ans", "level")
    per = rows.withColumn("key", key).groupBy("key").agg(F.count(F.lit(1)).alias("n_rows"), F.min(variant).alias("lo"), F.max(variant).alias("hi"), F.count_distinct(variant).alias("n_variants"))
    return per.filter("lo <> hi").select("key", "n_rows", "n_variants")


def id_conflicts(rows: DataFrame, key: Column) -> DataFrame:
    """(query_id, n_rows, n_questions): source ids that stand for several questions."""
    used = rows.filter("query_id is not null and query_id <> ''").withColumn("key", key)
    return used.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("key").alias("n_questions")).filter("n_questions > 1")


def split_by_position(position: Column, n: Column, train: float, validation: float) -> Column:
    """train, validation or test by position among ``n``; fractions are rounded down."""
    first, second = F.floor(n * train), F.floor(n * validation)
    return F.when(position < first, "train").when(position < first + second, "validation").otherwise("test")


def hash_split(questions: DataFrame, seed: int = 42, train: float = 0.625, validation: float = 0.125) -> DataFrame:
    """``questions``(sample_id, difficulty, ...) with position, global_index and split.

    The order within a difficulty is that of a content hash: it does not depend on input
    order, files or partitions. sample_id must be unique.
    """
    ranked = numbered(questions, ["difficulty"], [seeded_digest(seed, F.col("sample_id"))])
    sizes = ranked.groupBy(F.col("difficulty").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    joined = ranked.join(sizes, F.col("difficulty").eqNullSafe(F.col("d")))
    return joined.select(*ranked.columns, split_by_position(F.col("position"), F.col("n"), train, validation).alias("split"))


def picked(numbered_rows: DataFrame, index: str, wanted: Sequence[int]) -> DataFrame:
    """The rows at the positions ``wanted`` (in that order, as ``pick``), each as often as it is named.

    A negative position or one beyond the last row is an error. ``wanted`` is a list written down by
    hand or in a config, so it is small; the rows may be many.
    """
    last = numbered_rows.agg(F.max(index)).first()[0]
    size = -1 if last is None else last
    outside = [x for x in wanted if not 0 <= x <= size]
    if outside:
        raise IndexError(f"positions outside 0..{size}: {outside[:10]}")
    pick = numbered_rows.sparkSession.createDataFrame([(k, int(x)) for k, x in enumerate(wanted)], f"pick int, `{index}` bigint")
    return numbered_rows.join(F.broadcast(pick), index)


def hash_top(questions: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """The first ``n`` questions by content hash (a top-k, no full sort); 0 means all."""
    ordered = questions.withColumn("hash", seeded_digest(seed, F.col("sample_id")))
    return ordered.orderBy("hash").limit(n) if n else ordered


def one_per_difficulty(questions: DataFrame, seed: int = 42) -> DataFrame:
    """One question per difficulty: the least content hash of [seed, difficulty, id]."""
    rank = F.sha2(F.concat(F.lit(f"[{seed},"), F.col("difficulty").cast("string"), F.lit(',"'), F.col("sample_id"), F.lit('"]')), 256)
    return first_by(questions, ["difficulty"], rank)


def excluded(questions: DataFrame, other: DataFrame) -> DataFrame:
    """Questions that another run doesn't use."""
    return questions.join(other.select("sample_id").distinct(), "sample_id", "left_anti")


def overlap(questions: DataFrame, other: DataFrame) -> DataFrame:
    """Questions that another run uses too; must be empty for a leak-free evaluation."""
    return questions.join(other.select("sample_id").distinct(), "sample_id", "left_semi")


def prepare(raw_question: DataFrame, seed: int = 42, train: float = 0.625, validation: float = 0.125) -> DataFrame:
    """The manifest of a raw table: accepted rows, one per normalized question, split by content hash.

    Copies that disagree keep their first row; ``answer_conflicts`` and ``id_conflicts`` list them.
    """
    rows = accepted(raw_rows(raw_question)).withColumn("identity", question_identity(F.col("query")))
    rows = rows.select("*", F.col("identity.key").alias("key"), F.col("identity.sample_id").alias("sample_id")).drop("identity")
    first = first_by(rows, ["key"], F.col("raw_id"))
    source = F.coalesce(F.when(F.col("query_id") != "", F.col("query_id")), F.col("sample_id"))
    questions = first.select("sample_id", F.col("query").alias("question"), "gt_ans", F.col("level").alias("difficulty"), source.alias("source_query_id"))
    return hash_split(questions, seed, train, validation)


def latest_manifest(manifest: DataFrame, *columns: str) -> DataFrame:
    """One row per record, the latest delivery, with ``columns`` (all if none are named)."""
    return first_by(manifest, ["sample_id", "global_index"], F.struct("prepared_at", "source_query_id"), last=True, keep=list(columns) or None)


def manifest_violations(manifest: DataFrame) -> DataFrame:
    """(rule, value, n): one row per broken rule and value of a manifest.

    Rules: duplicate_sample, duplicate_question, duplicate_source, missing_answer, bad_difficulty, bad_split,
    position_gap (positions of a difficulty aren't 0..n-1), index_gap (indexes aren't
    contiguous), split_order (train, validation, test must follow each other).
    """
    one = F.lit(1)
    rule = lambda df, name, value, n="n": df.select(F.lit(name).alias("rule"), F.coalesce(F.col(value).cast("string"), F.lit("")).alias("value"), F.col(n).cast("bigint").alias("n"))
    repeated = lambda c: manifest.filter(F.col(c).isNotNull()).groupBy(c).agg(F.count(one).alias("n")).filter("n > 1")
    where = lambda cond, c: manifest.filter(cond).groupBy(c).agg(F.count(one).alias("n"))
    per = manifest.groupBy("difficulty").agg(F.count_distinct("position").alias("n"), F.min("position").alias("lo"), F.max("position").alias("hi"), F.max(F.when(F.col("split") == "train", F.col("position"))).alias("t"), F.min(F.when(F.col("split") == "validation", F.col("position"))).alias("v0"), F.max(F.when(F.col("split") == "validation", F.col("position"))).alias("v1"), F.min(F.when(F.col("split") == "test", F.col("position"))).alias("e"))
    whole = manifest.agg(F.count_distinct("global_index").alias("n"), F.min("global_index").alias("lo"), F.max("global_index").alias("hi"))
    return (
        rule(repeated("sample_id"), "duplicate_sample", "sample_id")
        .union(rule(repeated("question").select(F.sha2("question", 256).alias("question"), "n"), "duplicate_question", "question"))
        .union(rule(repeated("source_query_id"), "duplicate_source", "source_query_id"))
        .union(rule(where(~F.coalesce(F.trim("gt_ans") != "", F.lit(False)), "split"), "missing_answer", "split"))
        .union(rule(where(~F.coalesce(F.col("difficulty").between(1, 5), F.lit(False)), "difficulty"), "bad_difficulty", "difficulty"))
        .union(rule(where(~F.coalesce(F.col("split").isin("train", "validation", "test"), F.lit(False)), "split"), "bad_split", "split"))
        .union(rule(per.filter("lo <> 0 or hi <> n - 1"), "position_gap", "difficulty"))
        .union(rule(whole.filter("n > 0 and (lo <> 0 or hi <> n - 1)"), "index_gap", "hi"))
        .union(rule(per.filter("t > v0 or v1 > e or t > e"), "split_order", "difficulty"))
    )


def identity_violations(manifest: DataFrame) -> DataFrame:
    """(sample_id): records whose id isn't the digest of their question's duplicate key."""
    own = question_identity(F.col("question"))
    return manifest.select("sample_id", own.alias("own")).filter(~F.coalesce(F.col("own.sample_id") == F.col("sample_id"), F.lit(False))).select("sample_id")
