"""Nulls in every column, repeated rows and clashing extra columns for all dealt operators."""

from pyspark.sql import functions as F

from pathloom.llm import copies, groups, leakage, neardup, packing, sampling, spam, unify

LONG = " ".join(f"w{k}" for k in range(40))
OTHER = LONG.replace("w7 ", "zz ")


def _texts(spark):
    rows = [("a", 1, 0, LONG), ("a", 2, 1, OTHER), ("a", 2, 1, OTHER), (None, 3, 0, LONG), ("a", None, 0, OTHER), ("a", 4, None, LONG), ("a", 5, 0, None), ("a", 6, 0, ""), ("a", 7, 1, " 　 "), ("a", 8, 1, "word " * 4000)]
    df = spark.createDataFrame(rows, "tab string, id bigint, side int, text string")
    return df.withColumns({c: F.lit("x") for c in ("n", "tok", "c1", "pos", "form", "key_0", "salt", "h1")})


def test_near_duplicates(spark):
    df = _texts(spark)
    assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == {("a", 1, 2), ("a", 2, 4)}
    assert {tuple(r) for r in neardup.cross_split_pairs(df).collect()} == {(1, 2)}
    assert {r.id for r in groups.near_duplicate_groups(df).collect()} == {1, 2, 4}


def test_forms_and_copies(spark):
    df = _texts(spark)
    assert unify.hidden_twins(df).count() == 0
    got = copies.copy_pairs(df.withColumn("is_json", F.lit(None).cast("boolean")))
    assert {tuple(r) for r in got.collect()} == {("a", 1, 4)}


def test_sample_keeps_clashing_columns(spark):
    df = _texts(spark).withColumn("m", F.create_map(F.lit("a"), F.lit(1)))
    out = sampling.stable_sample(df, "tab", ["side"], sampling.Rates({}, 1.0))
    assert out.columns == df.columns and out.count() == df.filter("tab is not null").count()


def test_documents(spark):
    df = _texts(spark).withColumnRenamed("id", "doc_id").withColumns({"url": F.lit(None).cast("string"), "source": F.lit(None).cast("string"), "item_id": F.col("doc_id")})
    pairs = {tuple(r) for r in leakage.leaked_pairs(df, df).collect()}
    assert pairs == {(a, b) for a in (1, 2, 3, 4) for b in (1, 2, 3, 4)} | {(8, 8)}
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == {8}
    counts = df.select("doc_id", F.when(F.col("doc_id") != 4, 30).alias("n_tokens"), F.lit("x").alias("g"))
    assert packing.containers(counts, 64).count() == df.count()
