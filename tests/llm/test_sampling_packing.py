import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.llm import packing, sampling

RATES = sampling.Rates({"train|1": 0.3, "test|": 0.8}, 0.1)


def _rows(n):
    return [(f"k{i % (n // 2)}", ["train", "test", None][i % 3], [1, None, 2][i % 3], i) for i in range(n)]


def test_sample_is_stable(spark):
    df = spark.createDataFrame([*_rows(600), (None, "train", 1, 9999)], "key string, split string, level int, at int")
    pick = lambda d, rates=RATES: {(r.key, r.at) for r in sampling.stable_sample(d, "key", ["split", "level"], rates).collect()}
    whole = pick(df)
    assert whole == pick(df.repartition(7).orderBy(F.desc("at")))
    keys = {k for k, _ in whole}
    assert whole == {(k, a) for k, _, _, a in _rows(600) if k in keys}
    assert {k for k, _ in pick(df.filter("at < 300"))} <= keys
    raised = sampling.Rates({"train|1": 0.4, "test|": 0.8, "|2": 0.9}, 0.1)
    assert whole <= {(r.key, r.at) for r in sampling.stable_sample(df, "key", ["split", "level"], raised, before=RATES).collect()}
    assert sampling.stable_sample(df.limit(0), "key", ["split"], sampling.Rates({})).count() == 0
    assert df.columns == sampling.stable_sample(df, "key", ["split", "level"], RATES).columns


@pytest.mark.parametrize("lower", [sampling.Rates({"train|1": 0.2, "test|": 0.8}, 0.1), sampling.Rates(RATES.named, 0.05), sampling.Rates({"train|1": 0.3, "test|": 0.8, "|2": 0.05}, 0.1), sampling.Rates({}, 0.2)])
def test_rates_never_fall(spark, lower, tmp_path):
    with pytest.raises(ValueError, match="only rise"):
        sampling.stable_sample(spark.createDataFrame(_rows(4), "key string, split string, level int, at int"), "key", ["split"], lower, before=RATES)
    path = f"file://{tmp_path}/rates"
    assert sampling.stored_rates(spark, path) is None
    sampling.store_rates(spark, path, RATES)
    with pytest.raises(ValueError, match="only rise"):
        sampling.store_rates(spark, path, lower)
    assert sampling.stored_rates(spark, path) == RATES
    assert sampling.store_rates(spark, path, sampling.Rates(RATES.named, 0.2)).default == 0.2


def test_rates_are_probabilities():
    for rate in (-0.1, 1.5, float("nan")):
        with pytest.raises(ValueError):
            sampling.Rates({"a": rate})


def test_growth_replay_keeps_all(spark):
    df = spark.createDataFrame(_rows(600), "key string, split string, level int, at int").withColumn("t", F.timestamp_seconds(F.col("at") * 86400 * 2))
    rows = sampling.growth_replay(df, "key", "t", ["split", "level"], RATES).orderBy("month").collect()
    assert all(b.kept == a.chosen for a, b in itertools.pairwise(rows)) and rows[0].kept == 0
    assert rows[-1].records == 300


def test_differencing_small_cases():
    window, sums = packing.differencing(np.array([8, 7, 6, 5, 4]), 2)
    assert sums.max() <= 16 and sums.sum() == 30
    for k in (1, 2, 3, 5):
        sizes = np.random.default_rng(k).integers(1, 100, 40)
        window, sums = packing.differencing(sizes, k)
        assert sorted(np.bincount(window, weights=sizes, minlength=k).astype(int)) == sorted(sums.tolist())


@pytest.mark.parametrize("seed", range(4))
def test_pack_is_valid_and_tight(seed):
    sizes = np.random.default_rng(seed).integers(0, 513, 500)
    window = packing.pack(sizes, 512)
    load = np.bincount(window, weights=sizes)
    assert load.max() <= 512
    assert load.sum() / (512 * len(load)) > 0.93
    assert len(packing.pack(np.zeros(0, int), 512)) == 0
    assert set(packing.pack(np.zeros(3, int), 512)) == {0}


@pytest.mark.parametrize("group_items", [5, 1000])
def test_containers_hold_every_token_once(spark, group_items):
    sizes = [0, 0, 1, 99, 100, 101, 250, 700, 3, 50, 50, 1000, 64, 36]
    df = spark.createDataFrame([*enumerate(sizes), (None, 10)], "doc_id bigint, n_tokens bigint")
    rows = packing.containers(df, 100, group_items).collect()
    for i, n in enumerate(sizes):
        parts = sorted((r.first_token, r.n_tokens) for r in rows if r.doc_id == i)
        assert sum(k for _, k in parts) == n and parts[0][0] == 0
        assert all(a + k == b for (a, k), (b, _) in itertools.pairwise(parts))
        assert len(parts) == 1 or n > 100
    boxes = {}
    for r in rows:
        boxes.setdefault(r.container, []).append((r.place, r.n_tokens))
    for box in boxes.values():
        at = 0
        for place, k in sorted(box):
            assert place == at
            at += k
        assert at <= 100
    assert packing.containers(df.limit(0), 100).count() == 0


def test_token_counts_equal_the_tokenizer(spark):
    import os

    if not os.path.exists(packing.VOCABULARY):
        pytest.skip("no vocabulary files")
    texts = [None, "", "Hello world", "naïve  café\n\n\t x^2 – 3.5", "ab" * 5000, "  "]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df).collect()}
    assert got == {i: len(packing._encoding(packing.VOCABULARY).encode_ordinary(t or "")) for i, t in enumerate(texts)}


def test_one_id_in_very_many_rows(spark):
    df = spark.range(3000).selectExpr("cast(5 as bigint) doc_id", "id % 90 n_tokens").union(spark.range(500).selectExpr("cast(null as bigint)", "id % 90"))
    rows = packing.containers(df, 100, 50).collect()
    assert len(rows) == 3500 and sum(r.n_tokens for r in rows) == df.agg(F.sum("n_tokens")).first()[0]
    load = {}
    for r in rows:
        load[r.container] = load.get(r.container, 0) + r.n_tokens
    assert max(load.values()) <= 100
