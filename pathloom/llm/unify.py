"""Problem 4: one consistent form for texts that look the same.

The form is computed relationally. A text that has only characters without another plain
form needs no more than blank folding. All others are exploded to positioned pieces (runs
of plain ASCII, or one character with the marks and invisible characters after it) and the
pieces to positioned code points; a broadcast join maps each code point to its decomposed
plain characters and their combining classes; marks are ordered by class, clusters are
recomposed by a second broadcast join (step by step where only a part of the marks composes)
and the strings rebuilt in order. Letters and vowel signs that compose without a mark, and Hangul
syllables by arithmetic, are put together in the rebuilt text. All lookup tables
come from the Unicode database and have a few thousand rows, whatever the data.
"""

from __future__ import annotations

import unicodedata as ud

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import hot_joined, parallelism, written
from .text import CHANGED, COMBINING, COMPOSED, PAIRS, PLAIN, STARTER_PAIRS, char_class

#: Characters that join the cluster before them: combining marks, characters that stand for some, and invisible characters.
_JOINERS = char_class([*COMBINING, *(c for c, to in PLAIN.items() if not to or ud.combining(to[0]))])
_JAMO = [chr(c) for c in range(0x1100, 0x1200)]
_SUSPECT = {*CHANGED, *COMBINING, *_JAMO, *(x[1] for x in STARTER_PAIRS)} - set(" \t\n\r")
_SAFE = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x10000)] if chr(c) not in _SUSPECT]
#: A character that may have another plain form. ASCII, then common letters are told apart first, for speed.
SUSPECT = f"[^\\t\\n\\r -~](?<![{char_class(c for c in _SAFE if ord(c) < 0x250)}])(?<![{char_class(_SAFE)}])"
PIECE = f"(?s)[\\t\\n\\r -~]+(?![{_JOINERS}])|[^{_JOINERS}][{_JOINERS}]*|[{_JOINERS}]+"


#: Two or three letters of a syllable, or a syllable and its last letter.
_SYLLABLE = "(?:[\\u1100-\\u1112][\\u1161-\\u1175][\\u11A8-\\u11C2]?|[\\uAC00-\\uD7A3][\\u11A8-\\u11C2])"


_MARK_PAIRS = {k: v for k, v in PAIRS.items() if ud.combining(k[1])}
_FIRST, _SECOND = char_class(x[0] for x in STARTER_PAIRS), char_class(x[1] for x in STARTER_PAIRS)


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*(F.lit(x) for kv in sorted(pairs.items()) for x in kv)), key)


def _stepwise(base: Column, marks: Column) -> Column:
    """A base with ordered marks (c, ccc), of which each composes that no uncomposed mark of its class precedes."""
    text, number = F.lit("").cast("string"), F.lit(0).cast("int")

    def step(acc: Column, m: Column) -> Column:
        both = F.when((acc["rest"] == "") | (acc["last"] < m["ccc"]), _lookup(_MARK_PAIRS, F.concat(acc["base"], m["c"])))
        return F.struct(F.coalesce(both, acc["base"]).alias("base"), F.when(both.isNull(), F.concat(acc["rest"], m["c"])).otherwise(acc["rest"]).alias("rest"), F.when(both.isNull(), m["ccc"]).otherwise(acc["last"]).alias("last"))

    start = F.struct(F.coalesce(base, F.lit("")).alias("base"), text.alias("rest"), number.alias("last"))
    return F.aggregate(marks, start, step, lambda acc: F.concat(acc["base"], acc["rest"]))


def _starters(text: Column) -> Column:
    """Neighbouring letters and signs that compose without a mark."""

    def one(x: Column) -> Column:
        rest = F.regexp_extract_all(F.substring(x, 2, 1 << 30), F.lit("(?s)."), F.lit(0))
        put = lambda acc, c: F.coalesce(F.concat(F.left(acc, F.length(acc) - 1), _lookup(STARTER_PAIRS, F.concat(F.right(acc, F.lit(1)), c))), F.concat(acc, c))
        return F.when(F.length(x) < 2, x).otherwise(F.aggregate(rest, F.left(x, F.lit(1)), put))

    run = f"[{_FIRST}][{_SECOND}]+"
    pieces = F.regexp_extract_all(text, F.lit(f"(?s){run}|."), F.lit(0))
    return F.when(text.rlike(run), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def evened(text: Column) -> Column:
    """Runs of ordinary blanks as one, none at the ends."""
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def mapping(spark: SparkSession) -> DataFrame:
    """(ch, parts): each character with another plain form, as its decomposed characters with combining classes."""
    rows = {c: [(x, ud.combining(x)) for x in to] for c, to in PLAIN.items()}
    rows |= {c: [(c, ud.combining(c))] for c in COMBINING if c not in rows}
    return spark.createDataFrame(sorted(rows.items()), "ch string, parts array<struct<c:string,ccc:int>>")


def compositions(spark: SparkSession) -> DataFrame:
    """(tail, composed): each composed character by its base and marks in canonical order."""
    return spark.createDataFrame(sorted(COMPOSED.items()), "tail string, composed string")


def _syllables(text: Column) -> Column:
    """Hangul letters composed to syllables by arithmetic, as they are in the Unicode standard."""
    code = lambda x, k: F.ascii(F.substring(x, k, 1))
    char = lambda n: F.decode(F.unhex(F.hex(n)), "UTF-16BE")
    last = lambda x, k: F.when(F.length(x) >= k, code(x, k) - 0x11A7).otherwise(0)

    def one(x: Column) -> Column:
        first = code(x, 1)
        letters = char((0xAC00 + ((first - 0x1100) * 21 + code(x, 2) - 0x1161) * 28 + last(x, 3)).cast("bigint"))
        closed = char((first + last(x, 2)).cast("bigint"))
        return F.when(F.length(x) < 2, x).when(first < 0x1113, letters).when((first - 0xAC00) % 28 == 0, closed).otherwise(x)

    pieces = F.regexp_extract_all(text, F.lit(f"(?s){_SYLLABLE}|."), F.lit(0))
    return F.when(text.rlike(_SYLLABLE), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def consistent_form(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and ``form`` of each row of ``df``; rows with the same keys must have the same text.

    Repeated rows may come out once or more often.

    Null stays null; empty, blank and wholly invisible texts become the empty string.
    Other columns of ``df`` are ignored, so their names can't clash.
    """
    src = df.select(*(F.col(k).alias(f"key_{i}") for i, k in enumerate(keys)), F.col(text).cast("string").alias("text_in"))
    ks = [f"key_{i}" for i in range(len(keys))]
    dirty = F.coalesce(F.col("text_in").rlike(SUSPECT), F.lit(False))
    spark = df.sparkSession
    plain = src.filter(~dirty).select(*ks, evened(F.col("text_in")).alias("form"))

    # the same partitioning serves the removal of repeated rows and both regroupings
    spread = src.filter(dirty).repartition(parallelism(spark), *ks).groupBy(*ks).agg(F.first("text_in").alias("text_in"))
    piece = spread.select(*ks, F.posexplode(F.regexp_extract_all("text_in", F.lit(PIECE), F.lit(0))).alias("pos", "piece"))
    point = piece.select(*ks, "pos", F.posexplode(F.when(F.col("piece").rlike("[^\\t\\n\\r -~]"), F.regexp_extract_all("piece", F.lit("(?s)."), F.lit(0))).otherwise(F.array("piece"))).alias("sub", "ch"))
    own = F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc")))
    mapped = point.join(F.broadcast(mapping(spark)), "ch", "left").select(*ks, "pos", "sub", F.posexplode_outer(F.coalesce("parts", own)).alias("k", "part"))
    part = F.struct((F.col("part.ccc") > 0).alias("mark"), F.col("part.ccc").alias("ccc"), "sub", "k", F.col("part.c").alias("c"))
    cluster = mapped.groupBy(*ks, "pos").agg(F.array_sort(F.collect_list(F.when(F.col("part").isNotNull(), part))).alias("all"))
    join = lambda a: F.array_join(F.transform(a, lambda x: x["c"]), "")
    bases, marks = F.filter("all", lambda x: ~x["mark"]), F.filter("all", lambda x: x["mark"])
    last = F.slice(bases, F.greatest(F.size(bases), F.lit(1)), 1)
    cluster = cluster.select(
        *ks, "pos", F.get(last, F.lit(0))["c"].alias("base"), marks.alias("marks"), F.when(F.size(marks) == 0, join(F.col("all"))).otherwise(join(F.slice(bases, 1, F.greatest(F.size(bases) - 1, F.lit(0))))).alias("head"),
        F.when(F.size(marks) > 0, F.concat(join(last), join(marks))).alias("tail"),
    )
    out = cluster.join(F.broadcast(compositions(spark)), "tail", "left").select(*ks, "pos", F.concat("head", F.coalesce("composed", F.when(F.size("marks") > 1, _stepwise(F.col("base"), F.col("marks"))), "tail", F.lit(""))).alias("out"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "out"))), lambda x: x["out"]), "")
    rebuilt = out.groupBy(*ks).agg(evened(whole).alias("form")).withColumn("form", _starters(_syllables(F.col("form"))))
    return plain.unionByName(rebuilt).select(*(F.col(f"key_{i}").alias(k) for i, k in enumerate(keys)), "form")


def hidden_twins(texts: DataFrame) -> DataFrame:
    """Pairs (tab, id_a, id_b), id_a < id_b, of rows of one table with the same consistent form whose stored texts differ in more than ordinary blanks.

    ``texts`` has (tab, id, text); other columns are ignored. Null, empty and blank texts and
    rows without table or id are no case, repeated rows of one id count once, an empty table
    gives no rows.
    """
    stored = F.unhex(F.md5(evened(F.col("text"))))
    rows = texts.filter(F.length(F.trim("text")) > 0).filter("tab is not null and id is not null").select("tab", F.col("id").cast("bigint").alias("id"), "text", stored.alias("stored"))
    formed = consistent_form(rows, ["tab", "id", "stored"]).filter("form <> ''")
    formed = written(formed.select("tab", "id", "stored", F.unhex(F.md5("form")).alias("form")).distinct(), "forms")
    several = formed.groupBy("tab", "form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter("lo <> hi").select("tab", "form")
    kept = written(formed.join(several, ["tab", "form"], "left_semi"), "twins")
    # stored texts meet, each once however many rows have it; then their rows come in
    text = kept.select("tab", "form", "stored").distinct()
    pairs = text.withColumnRenamed("stored", "stored_a").join(text.withColumnRenamed("stored", "stored_b"), ["tab", "form"]).filter("stored_a < stored_b")
    for at in ("a", "b"):
        pairs = hot_joined(kept.select("tab", "form", F.col("stored").alias(f"stored_{at}"), F.col("id").alias(f"of_{at}")), pairs, ["tab", "form", f"stored_{at}"])
    return pairs.filter("of_a <> of_b").select("tab", F.least("of_a", "of_b").alias("id_a"), F.greatest("of_a", "of_b").alias("id_b")).distinct()
