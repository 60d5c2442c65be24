"""Problems 1 and 2: near-duplicates with small edits, within a table and across splits."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import hot_joined, written
from .codes import code_pairs
from .overlap import similar_classes, verify, written_tokens

#: Share of the longer text's words that two near-duplicates have in common (TESTDATA.md).
THRESHOLD = Fraction(7, 10)


def questions(raw_question: DataFrame, manifest: DataFrame) -> DataFrame:
    """Both question tables as (tab, id, side, text)."""
    return raw_question.select(F.lit("raw_question").alias("tab"), F.col("raw_id").alias("id"), F.lit(0).alias("side"), F.col("query").alias("text")).union(
        manifest.select(F.lit("manifest").alias("tab"), F.col("global_index").cast("bigint").alias("id"), F.lit(0).alias("side"), F.col("question").alias("text"))
    )


def _members(tokens: DataFrame, c: str, out: str) -> DataFrame:
    return tokens.select("tab", F.col("c1").alias(c + "1"), F.col("c2").alias(c + "2"), F.col("id").alias(out), F.col("side").alias(out + "_side")).distinct()


def near_duplicates(texts: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """Pairs (tab, id_a, id_b), id_a < id_b, of rows of one table whose bare texts differ and whose words agree to ``threshold``.

    ``texts`` has (tab, id, side, text); other columns are ignored. Null, empty and blank
    texts match nothing; an id that comes twice counts once; an empty table gives no rows.
    """
    tokens = written_tokens(texts)
    classes = similar_classes(tokens, threshold).filter("x1 <> y1 or x2 <> y2").select("a1", "a2", "d1", "d2")
    a, b = _members(tokens, "a", "id_1"), _members(tokens, "d", "id_2")
    pairs = hot_joined(b.withColumnRenamed("tab", "tab_2"), hot_joined(a, classes, ["a1", "a2"]), ["d1", "d2"]).filter("tab = tab_2 and id_1 <> id_2")
    return pairs.select("tab", F.least("id_1", "id_2").alias("id_a"), F.greatest("id_1", "id_2").alias("id_b")).distinct()


def split_sides(manifest: DataFrame) -> DataFrame:
    """Manifest records as (tab, id, side, text): side 0 is train, 1 validation or test."""
    side = F.when(F.col("split") == "train", 0).when(F.col("split").isin("validation", "test"), 1)
    return manifest.select(F.lit("manifest").alias("tab"), F.col("global_index").cast("bigint").alias("id"), side.alias("side"), F.col("question").alias("text")).filter("side is not null and id is not null")


def cross_split_pairs(texts: DataFrame, threshold: Fraction = THRESHOLD, exact: bool = False) -> DataFrame:
    """Pairs (id_a, id_b), id_a < id_b, of a training and an evaluation record with the same bare text or words that agree to ``threshold``.

    ``texts`` has (tab, id, side, text); rows with another side than 0 or 1 are left out. Equal bare texts meet in a join on their 128-bit
    hash. Near-duplicates meet by their bit fingerprints: permuted code blocks are joined
    across the sides, pairs within the Hamming radius are verified on the words. With ``exact`` the blocks are those of the exact prefix join
    instead, which misses none. Null, empty and blank texts match nothing; an empty table gives no rows.
    """
    tokens = written_tokens(texts.filter("side in (0, 1)"))
    rows = tokens.select("id", "side", "b1", "b2").distinct()
    train, held = (rows.filter(F.col("side") == k).select("b1", "b2", F.col("id").alias(name)) for k, name in ((0, "id_t"), (1, "id_e")))
    same = hot_joined(train, held, ["b1", "b2"]).select("id_t", "id_e")
    if exact:
        classes = similar_classes(tokens, threshold, cross=True)
    else:
        classes = verify(written(code_pairs(tokens, threshold), "pairs"), tokens, threshold)
    classes = classes.select("a1", "a2", "d1", "d2")
    a, b = _members(tokens, "a", "id_1").drop("tab"), _members(tokens, "d", "id_2").drop("tab")
    near = hot_joined(b, hot_joined(a, classes, ["a1", "a2"]), ["d1", "d2"]).filter("id_1_side <> id_2_side").select("id_1", "id_2")
    pairs = same.union(near).filter("id_t <> id_e")
    return pairs.select(F.least("id_t", "id_e").alias("id_a"), F.greatest("id_t", "id_e").alias("id_b")).distinct()


def overlap_report(manifest: DataFrame, pairs: DataFrame) -> DataFrame:
    """(split, source, records, overlapping, pairs): per evaluation split and source, how many records also stand in train.

    The source is what precedes the last "/" of source_query_id, or "unknown" without one.
    """
    source = F.when(F.col("source_query_id").contains("/"), F.regexp_extract("source_query_id", "^(.*)/", 1)).otherwise("unknown")
    records = manifest.filter(F.col("split").isin("validation", "test")).groupBy(F.col("global_index").cast("bigint").alias("id")).agg(F.min("split").alias("split"), F.min(source).alias("source"))
    ends = pairs.select(F.col("id_a").alias("id")).union(pairs.select(F.col("id_b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return (
        records.join(ends, "id", "left").groupBy("split", "source")
        .agg(F.count(F.lit(1)).alias("records"), F.count("n").alias("overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"))
    )
