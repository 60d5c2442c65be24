import itertools
import random

from pyspark.sql import functions as F

from pathloom.functions import paths as px
from pathloom.functions.keys import digest_of


def _one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) if not isinstance(v, list) else F.array(*map(F.lit, v)).cast("array<int>").alias(k) for k, v in values.items()])
    return row.select(column.alias("x")).first().x


def test_hand_cases(spark):
    p = F.col("p")
    assert _one(spark, px.layer_actions(p, 4), p=[0, 2, 2, 3]) == ["keep", "skip", "loop", "keep"]
    assert _one(spark, px.layer_actions(p, 2), p=[0, 0, 0, 1]) is None
    assert _one(spark, px.layer_actions(p, 2), p=[0, 5]) is None
    assert spark.sql("SELECT array('loop','loop','keep') a").select(px.actions_path(F.col("a")).alias("x")).first().x == [0, 0, 1, 1, 2]
    assert spark.sql("SELECT array('skip','skip') a").select(px.actions_path(F.col("a")).alias("x")).first().x is None
    acts = spark.sql("SELECT array(named_struct('action','keep','size',2,'count',0), named_struct('action','skip','size',1,'count',0), named_struct('action','repeat','size',2,'count',1)) a")
    assert acts.select(px.decode_actions(F.col("a")).alias("x")).first().x == [0, 1, 3, 4, 3, 4]
    assert acts.select(px.actions_length(F.col("a")).alias("x")).first().x == 6
    assert _one(spark, px.local_edits(p, 2, 1, 3), p=[0, 1]) == [[0], [0, 0, 1], [0, 1, 1], [1]]
    assert _one(spark, px.edit_distance(p, F.col("q")), p=[0, 1, 2, 3], q=[0, 2, 2, 3, 3]) == 2
    assert _one(spark, px.operation_distance(p, F.col("q")), p=[0, 1, 2], q=[2, 1, 1]) == 3
    assert _one(spark, px.path_id(p), p=[0, 1, 10]) == digest_of([0, 1, 10])[:16]
    assert spark.range(1).select(px.seed_number(7, F.lit("ab")).alias("x")).first().x == int(digest_of([7, "ab"])[:8], 16)


def test_edits_equal_brute_force(spark):
    rng = random.Random(1)
    paths = [[rng.randrange(6) for _ in range(n)] for n in (1, 2, 3, 5, 8)]
    df = spark.createDataFrame([(i, p) for i, p in enumerate(paths)], "i int, p array<int>")
    got = {r.i: r.e for r in df.select("i", px.local_edits(F.col("p"), 3, 2, 9).alias("e")).collect()}
    for i, p in enumerate(paths):
        want = set()
        for a, b in itertools.combinations(range(len(p) + 1), 2):
            if b - a <= 3:
                want |= {tuple(p[:a] + p[b:]), *(tuple(p[:b] + p[a:b] * c + p[b:]) for c in (1, 2))}
        want = sorted(list(x) for x in want if 0 < len(x) <= 9 and list(x) != p)
        assert got[i] == want


def test_drop_full_path(spark):
    df = spark.createDataFrame([(1, [[0, 1, 2], [0, 2]]), (2, [[0, 1, 2], [0, 0, 1, 2]]), (3, []), (4, None)], "i int, ps array<array<int>>")
    out = {r.i: r.x for r in df.select("i", px.drop_full_path(F.col("ps"), 3).alias("x")).collect()}
    assert out == {1: [[0, 2]], 2: [[0, 1, 2], [0, 0, 1, 2]], 3: [], 4: None}


def test_clamp(spark):
    df = spark.createDataFrame([("2",), ("-1",), ("0.5",), ("x",), (None,)], "v string")
    assert [r.x for r in df.select(px.clamp01(F.col("v")).alias("x")).collect()] == [1.0, 0.0, 0.5, 1.0, 1.0]
