"""Groups of near-duplicates: connected components of similar texts, one row per record."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, written
from .neardup import THRESHOLD
from .overlap import similar_classes, written_tokens


def components(edges: DataFrame) -> DataFrame:
    """(node, label) of the undirected ``edges``(a, b): the least node of each component.

    Each round takes the least label among neighbours (combined before the shuffle) and then
    the label of the label, so long chains shrink fast. Rounds are written tables; only
    the number of changes reaches the driver.
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("label")), "labels")
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        hop = step.select(F.col("node").alias("label"), F.col("label").alias("far"))
        new = written(step.join(hop, "label", "left").select("node", F.least("label", F.coalesce("far", "label")).alias("label"), "old"), "labels")
        discard(labels)
        if new.filter("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicate_groups(texts: DataFrame, threshold: Fraction = THRESHOLD) -> DataFrame:
    """(tab, id, group_id, links): records with near-duplicates, their group (its least id) and to how many other texts they are linked.

    ``texts`` has (tab, id, side, text). Copies of one text are one node, so nothing is
    expanded to pairs of copies; records without near-duplicates have no row.
    """
    tokens = written_tokens(texts)
    pairs = written(similar_classes(tokens, threshold).filter("x1 <> y1 or x2 <> y2").select("a1", "a2", "d1", "d2").distinct(), "links")
    node = lambda p: F.concat_ws(":", "tab", F.hex(p + "1"), F.hex(p + "2"))
    inside = lambda p: tokens.select("tab", F.col("c1").alias(p + "1"), F.col("c2").alias(p + "2")).distinct()
    edges = written(pairs.join(inside("a"), ["a1", "a2"]).join(inside("d"), ["tab", "d1", "d2"]).select(node("a").alias("a"), node("d").alias("b")), "edges")
    found = components(edges)
    links = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).groupBy("node").agg(F.count(F.lit(1)).alias("links"))
    members = tokens.select("tab", "id", node("c").alias("node")).distinct().join(found.join(links, "node"), "node")
    least = members.groupBy("label").agg(F.min("id").alias("group_id"))
    return members.join(least, "label").groupBy("tab", "id").agg(F.min("group_id").alias("group_id"), F.max("links").alias("links"))
