import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import keys, paths
from pathloom.functions.keys import digest_of, plain_key, question_key_of
from pathloom.operators import geometry, ingest, lookup, mining, pairing, ranking, records, search, traces, transfer
from pathloom.plans import path_queries
from pathloom.sources import readers

RAW = "raw_id bigint, query string, gt_ans string, query_metadata struct<level:int>, query_id string, query4test boolean"


def _raw(n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        q = rng.choice([None, " ", "　"]) if rng.random() < 0.03 else f"Question  {rng.randrange(n)}　ｘ"
        rows.append((i, q, rng.choice(["1", "2", None]) if rng.random() < 0.05 else "5", (rng.choice([1, 2, 3, 4, 5, 9, None]) if rng.random() < 0.1 else rng.randrange(1, 6),), rng.choice([None, "", f"s/{i % 50}"]), rng.choice([False] * 9 + [None, True])))
    return rows


def test_prepare_equals_plain_python(spark):
    raw = _raw()
    seen = {}
    for i, q, a, (lv,), sid, test in raw:
        ok = q is not None and q.strip() and a is not None and a.strip() and lv in range(1, 6) and test is False
        if ok:
            seen.setdefault(question_key_of(q), (digest_of(question_key_of(q)), q, a, lv, sid))
    want, index = [], 0
    for d in range(1, 6):
        bucket = sorted((r for r in seen.values() if r[3] == d), key=lambda r: digest_of([42, r[0]]))
        t, v = int(len(bucket) * 0.625), int(len(bucket) * 0.125)
        for pos, r in enumerate(bucket):
            want.append((r[0], r[1], r[2], d, r[4] or r[0], pos, index, "train" if pos < t else "validation" if pos < t + v else "test"))
            index += 1
    df = spark.createDataFrame(raw, RAW)
    for version in (df, df.repartition(5).orderBy(F.rand(3))):
        got = ingest.prepare(version).select("sample_id", "question", "gt_ans", "difficulty", "source_query_id", "position", "global_index", "split").collect()
        assert sorted(map(tuple, got)) == sorted(want)
    assert ingest.prepare(df.limit(0)).count() == 0


def test_duplicates_first_and_last(spark):
    rows = ingest.accepted(ingest.raw_rows(spark.createDataFrame(_raw(), RAW)))
    first = {r.key: r.raw_id for r in ingest.unique_questions(rows, plain_key(F.col("query"))).collect()}
    last = {r.key: r.raw_id for r in ingest.unique_questions(rows, plain_key(F.col("query")), last=True).collect()}
    assert set(first) == set(last) and all(first[k] <= last[k] for k in first) and any(first[k] < last[k] for k in first)


def test_numbered_over_many_partitions(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.random()) for _ in range(500)]
    got = ranking.numbered(spark.createDataFrame(rows, "g string, x double").repartition(6), ["g"], [F.col("x")]).collect()
    want = sorted(rows, key=lambda r: ("" if r[0] is None else r[0], r[1]))
    at = {}
    expected = []
    for i, (g, x) in enumerate(want):
        expected.append((g, x, at.get(g, 0), i))
        at[g] = at.get(g, 0) + 1
    assert sorted(map(tuple, got), key=lambda r: r[3]) == expected


def test_readers(spark, tmp_path):
    good = {"query": "a", "gt_ans": "1", "query_metadata": {"level": 2}, "query_id": "x/1", "query4test": False}
    folder = tmp_path / "lines"
    folder.mkdir()
    (folder / "a.jsonl").write_text(json.dumps(good) + "\n" + json.dumps(good) + "\n")
    assert readers.read_questions(spark, str(folder)).filter("query = 'a' and query_metadata.level = 2").count() == 2
    (folder / "a.jsonl").write_text('{"query": 1, "query": 2}\n')
    with pytest.raises(Exception, match="duplicate key"):
        readers.read_questions(spark, str(folder)).collect()
    (tmp_path / "one.json").write_text(json.dumps([good, good, good]))
    assert readers.read_questions(spark, str(tmp_path / "one.json")).count() == 3
    shards = tmp_path / "shards"
    for k in (0, 2):
        spark.createDataFrame([("a", "1")], "query string, gt_ans string").coalesce(1).toPandas().to_parquet(tmp_path / "x.parquet")
        shards.mkdir(exist_ok=True)
        (tmp_path / "x.parquet").rename(shards / f"train-{k:05d}-of-00003.parquet")
    with pytest.raises(ValueError, match="incomplete"):
        readers.read_questions(spark, str(shards))
    with pytest.raises(Exception):
        readers.read_questions(spark, str(tmp_path / "none"))
    assert [readers.strict_error(x) for x in (None, " ", "{", '{"a":1,"a":2}', '{"a":NaN}', "[1]", '{"a":[1]}')] == ["blank", "blank", "damaged", "duplicate key", "non-finite", "no object", None]
    inv = readers.file_inventory(spark, str(folder)).collect()
    assert [(r.file, r.bytes) for r in inv] == [("a.jsonl", (folder / "a.jsonl").stat().st_size)] and len(inv[0].sha256) == 64


def test_dataset_specs(spark):
    assert readers.parse_dataset("math;level=[1,2];domain=algebra;ref_ans=int;sample=10") == ("math", {"level": [1, 2], "domain": "algebra", "ref_ans": "int", "sample": 10})
    with pytest.raises(ValueError):
        readers.parse_dataset("math;level")
    df = spark.createDataFrame([(1, 1, "4"), (2, 2, "4.5"), (3, 1, "x"), (4, 3, "6.0")], "id int, level int, ref_ans string")
    assert {r.id for r in readers.filtered(df, {"level": [1, 3], "ref_ans": "int"}, "id").collect()} == {1, 4}
    assert readers.filtered(df, {"sample": 2}, "id").count() == 2


def test_records_and_mining_equal_plain_python(spark):
    depth, rng = 4, random.Random(5)
    full = [0, 1, 2, 3]
    pool = [full, [0, 1, 3], [0, 0, 1, 2, 3], [1, 2, 3], [0, 1, 2, 2, 3], [0, 1, 0, 1, 2, 3], [0, 1]]
    rows = []
    for i in range(40):
        ps = rng.sample(pool, rng.randint(0, 5))
        k = rng.randint(0, len(ps))
        rows.append((f"s{i}", f"q{i}", "1", 1 + i % 2, "train" if i % 4 else "test", ps[:k] or None, ps[k:]))
    df = spark.createDataFrame(rows, "sample_id string, question string, gt_ans string, difficulty int, split string, final_valid_transitions array<array<int>>, final_invalid_transitions array<array<int>>")
    weights = {}
    for _, _, _, d, s, v, n in rows:
        if s == "train":
            for o, ps in (("valid", v or []), ("invalid", n)):
                for p in ps:
                    for layer in range(depth):
                        a = ("skip", "keep", "loop")[p.count(layer)]
                        for g in (str(d), "all"):
                            weights[g, o, layer, a] = weights.get((g, o, layer, a), 0) + 1 / len(ps)
    got = {(r.grp, r.outcome, r.layer, r.action): r.weight for r in mining.layer_weights(df, depth).collect()}
    assert got.keys() == weights.keys() and all(abs(got[k] - weights[k]) < 1e-9 for k in got)
    cands = mining.candidates(df, max_candidates=9, min_support=3, most_edits=2, top_layers=4, depth=depth, max_length=6).collect()
    assert len(cands) <= 9 and len({tuple(c.path) for c in cands}) == len(cands)
    for c in cands:
        valid = {s for s, _, _, _, sp, v, _ in rows if sp == "train" and list(c.path) in (v or [])}
        seen = {s for s, _, _, _, sp, v, n in rows if sp == "train" and list(c.path) in (v or []) + n}
        assert (c.train_valid_support, c.train_observed_support, c.length) == (len(valid), len(seen), len(c.path)) and c.sources and c.candidate_id == digest_of(list(c.path))[:16]
    assert sum(any(s.startswith("single_") for s in c.sources) for c in cands) == 8
    examples = records.training_examples(df.filter("split = 'train'"), depth, drop_original=True).collect()
    per = {}
    for e in examples:
        per[e.sample_id] = per.get(e.sample_id, 0) + e.weight
    assert all(abs(w - 1) < 1e-9 for w in per.values())
    parity = records.loader_parity(df, depth).first()
    assert parity.expected == parity.loaded == sum(len(v or []) for _, _, _, _, s, v, _ in rows if s == "train")


def test_assignment_is_the_cheapest():
    rng = random.Random(4)
    assert pairing.assign([[4, 1, 3], [0, 2, 5]]) == [1, 0] and pairing.assign([]) == []
    with pytest.raises(ValueError):
        pairing.assign([[1], [2]])
    for _ in range(60):
        n = rng.randint(1, 5)
        m = rng.randint(n, 6)
        costs = [[rng.randint(0, 20) * 10**30 for _ in range(m)] for _ in range(n)]
        pick = pairing.assign(costs)
        assert len(set(pick)) == n
        assert sum(costs[i][j] for i, j in enumerate(pick)) == min(sum(costs[i][j] for i, j in enumerate(p)) for p in itertools.permutations(range(m), n))
        parts = [np.array([[rng.randint(0, 3) for _ in range(m)] for _ in range(n)]) for _ in range(3)]
        tie = np.arange(m)
        folded = pairing.folded(*parts, tie)
        key = lambda p: tuple(sum(int(x[i, j]) for i, j in enumerate(p)) for x in parts) + (sum(p),)
        assert key(pairing.assign(folded)) == min(key(p) for p in itertools.permutations(range(m), n))


def test_assignment_takes_all_wrong_paths(spark, monkeypatch):
    rng = random.Random(6)
    paths = {(d, tuple(sorted(rng.sample(range(28), rng.randint(20, 28))))) for d in (1, 2) for _ in range(75 if d == 1 else 12)}
    rows = [(d, f"{k:04d}", list(p), len(p), rng.randint(0, 60), k % 7 == 0) for k, (d, p) in enumerate(sorted(paths))]
    monkeypatch.setattr(path_queries, "_labelled", lambda *_: spark.createDataFrame(rows, "difficulty int, candidate_id string, path array<int>, length int, evaluation_index int, correct boolean"))
    got = {}
    for r in path_queries.pair_assignment(spark, "").collect():
        got.setdefault(r.difficulty, []).append(r)
    index = {r[1]: r[4] for r in rows}
    path = {r[1]: set(r[2]) for r in rows}
    assert sum(not r[5] for r in rows if r[0] == 1) > 40 and got
    for d, pairs in got.items():
        wrong = [r[1] for r in rows if r[0] == d and not r[5]]
        op = np.array([[len(path[p.correct_id] ^ path[w]) for w in wrong] for p in pairs])
        length = np.array([[abs(len(path[p.correct_id]) - len(path[w])) for w in wrong] for p in pairs])
        edit = np.array([[_levenshtein(sorted(path[p.correct_id]), sorted(path[w])) for w in wrong] for p in pairs])
        costs = pairing.folded(op, edit, length, np.array([index[w] for w in wrong]))
        best = sum(costs[i][j] for i, j in enumerate(pairing.assign(costs)))
        assert len({p.wrong_id for p in pairs}) == len(pairs)
        assert sum(costs[i][wrong.index(p.wrong_id)] for i, p in enumerate(pairs)) == best


def _levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_beam_search():
    seg, ops = np.array([-9.0, 9, -9, -9, -9, -9, -9]), np.log(np.array([[0.1, 0.8, 0.1], [0.6, 0.3, 0.1]] + [[1 / 3] * 3] * 3 + [[0.1, 0.2, 0.7], [0.5, 0.25, 0.25]]))
    got = lookup.decode(seg, ops, beam=3)
    assert got[0][0] == [("keep", 1, 0), ("skip", 4, 0), ("repeat", 2, 1)] and abs(got[0][1] - np.log(0.8 * 0.6 * 0.7)) < 1e-9
    assert len(got) == 3 and got[0][1] >= got[1][1] >= got[2][1]


def test_lookup_priority(spark):
    r = spark.createDataFrame([("s", [[0, 1]], [[0, 1], [1]]), ("t", None, None)], "sample_id string, final_valid_transitions array<array<int>>, final_invalid_transitions array<array<int>>")
    d = spark.createDataFrame([("s", 1, [0, 1]), ("s", 2, [1]), ("s", 3, [0]), ("s", 4, []), ("t", 1, [0])], "sample_id string, rank int, path array<int>")
    kinds = {(x.sample_id, x.rank): x.lookup_type for x in lookup.looked_up(d, r).collect()}
    assert kinds == {("s", 1): "valid_cache", ("s", 2): "invalid_cache", ("s", 3): "online", ("s", 4): "empty", ("t", 1): "online"}
    online = spark.createDataFrame([("t", [0], 1.0)], "sample_id string, path array<int>, online_score double")
    b = lookup.cache_breakdown(lookup.sample_results(lookup.looked_up(d, r), online)).first()
    assert (b.samples, b.correct_found, b.via_valid, b.via_online, b.valid_path_hits, b.online_paths) == (2, 2, 1, 1, 1, 2)


def test_search_is_reproducible_and_sound(spark):
    q = spark.createDataFrame([("a", "train"), ("b", "test"), ("c", "train")], "sample_id string, split string")
    run = lambda d: sorted(map(str, search.search_questions(d, depth=6, simulations=12).collect()))
    assert run(q) == run(q.repartition(3))
    rec = search.search_questions(q, depth=6, simulations=12)
    manifest = rec.withColumns({"question": F.lit("x"), "written_at": F.lit(None).cast("timestamp")})
    assert records.violations(manifest, 6, 6).count() == 0
    assert records.transition_violations(manifest, 6).count() == 0
    rows = {r.sample_id: r for r in rec.collect()}
    assert len(rows["b"].evaluations) == 1 and rows["a"].search_statistics.simulations_completed == 12
    bad = search.search_questions(q, depth=6, simulations=3, scorer=lambda s, p, k: 0.5).collect()
    assert all(r.status == "failed" and "binary" in r.failure_reason for r in bad)
    stopped = search.search_questions(q, depth=6, simulations=500, stop_every=4, stop_target=2).filter("split = 'train'").collect()
    assert all(r.search_statistics.stopped_early for r in stopped)


def test_quota_and_budget(spark):
    t = spark.createDataFrame([("s", i, [i], float(i % 2)) for i in range(9)] + [("u", 0, [0], 1.0)], "sample_id string, evaluation_index int, path array<int>, score double")
    out = {r.sample_id: (r.stop_index, r.correct, r.wrong) for r in traces.quota_stop(t, 3, 2).collect()}
    assert out == {"s": (3, 2, 2), "u": (None, None, None)}


def test_geometry(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(80, 6))
    df = spark.createDataFrame([(i, v.tolist(), (v @ np.diag([1, 2, 3, 1, 1, 1])).tolist()) for i, v in enumerate(x)] + [(500, None, None)], "vec_id bigint, vec array<double>, other array<double>")
    got = {(r.query_id, r.rank): r.neighbor_id for r in geometry.nearest(df, df.filter("vec_id < 10"), 5).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(u @ u.T, 6)
    np.fill_diagonal(s, -9)
    for i in range(10):
        assert [got[i, k + 1] for k in range(5)] == sorted(range(80), key=lambda j: (-s[i, j], j))[:5]
    y = x @ np.diag([1, 2, 3, 1, 1, 1])
    a, b = x - x.mean(0), y - y.mean(0)
    k, m = a @ a.T, b @ b.T
    want = (k * m).sum() / np.sqrt((k * k).sum() * (m * m).sum())
    row = geometry.linear_cka(df, "vec", "other").first()
    assert row.n == 80 and abs(row.cka - want) < 1e-5
    assert geometry.linear_cka(df.limit(0), "vec", "other").first().cka == 0.0
    plane = geometry.principal_plane(df, "vec_id", "vec").toPandas().sort_values("id")
    _, _, v = np.linalg.svd(a)
    assert np.allclose(np.abs(plane[["x", "y"]].to_numpy()), np.abs(a @ v[:2].T), atol=1e-4)


def test_bootstrap_brackets_the_gain(spark):
    rng = random.Random(9)
    df = spark.createDataFrame([(f"q{i}", "test", 1, 0.0, "c", float(rng.random() < 0.3)) for i in range(60)], "sample_id string, split string, difficulty int, baseline double, candidate_id string, score double")
    m, ci = transfer.metrics(df).first(), transfer.bootstrap(df, 300).first()
    assert ci.gain_low <= m.gain <= ci.gain_high and ci.gain_high - ci.gain_low < 0.3
    assert transfer.bootstrap(df, 300, seed=1).first() != ci


def test_held_out_scores_are_checked_against_any_number_of_candidates(spark):
    n = 10_001
    cands = spark.range(n).select(F.format_string("c%05d", "id").alias("candidate_id"))
    scores = "map_from_arrays(transform(sequence(0, {}), x -> format_string('c%05d', x)), array_repeat(1.0D, {}))"
    rows = [("whole", n - 1, n), ("short", n - 2, n - 1)]
    recs = None
    for name, last, k in rows:
        one = spark.sql(f"select '{name}' sample_id, 'test' split, 'complete' status, 1.0D baseline_score, {scores.format(last, k)} scores, '' failure_reason")
        recs = one if recs is None else recs.union(one)
    odd = spark.sql("select 'odd' sample_id, 'test' split, 'failed' status, 0.0D baseline_score, map('none', 1.0D) scores, 'x' failure_reason union all select 'null', 'test', 'failed', null, null, 'x' union all select null, 'test', 'failed', null, null, 'x'")
    got = {tuple(r) for r in records.universal_violations(recs.union(odd), cands).collect()}
    assert got == {("short", "missing_candidate"), ("odd", "unknown_candidate"), (None, "no_id")}


def test_checksums_are_attached_and_verified(spark):
    df = spark.createDataFrame([("a", 1, 0.1, [1, 2], "é\"\\"), ("b", None, float("inf"), None, None)], "id string, n int, x double, p array<int>, t string")
    signed = records.checksummed(df, ["id", "n", "p", "t"])
    by_id = {r.id: r.record_digest for r in signed.collect()}
    assert by_id["a"] == digest_of({"id": "a", "n": 1, "p": [1, 2], "t": "é\"\\"}) and by_id["b"] == digest_of({"id": "b", "n": None, "p": None, "t": None})
    assert records.digest_violations(signed, "id", ["id", "n", "p", "t"]).count() == 0
    changed = signed.withColumns({"n": F.lit(7), "record_digest": F.when(F.col("id") == "a", F.col("record_digest"))})
    assert {tuple(r) for r in records.digest_violations(changed, "id", ["id", "n", "p", "t"]).collect()} == {("a", "wrong_digest"), ("b", "no_digest")}
    assert records.config_violations(df.withColumn("c", F.lit("x")), "c").count() == 0
    assert {tuple(r) for r in records.config_violations(df.withColumn("c", F.col("t")), "c").collect()} == {("", 1), ("é\"\\", 1)}


def test_ids_are_digests_of_questions(spark):
    key = keys.question_key_of("Ａ  b")
    df = spark.createDataFrame([(digest_of(key), "Ａ  b"), ("0" * 64, "c"), ("1" * 64, None)], "sample_id string, question string")
    assert {r.sample_id for r in ingest.identity_violations(df).collect()} == {"0" * 64, "1" * 64}


def test_explicit_positions_are_picked_within_bounds(spark):
    df = spark.range(10).select(F.col("id").alias("at"), (F.col("id") * 10).alias("x"))
    assert [(r.pick, r.x) for r in ingest.picked(df, "at", [3, 0, 3]).orderBy("pick").collect()] == [(0, 30), (1, 0), (2, 30)]
    for wrong in ([10], [-1], [0, 99]):
        with pytest.raises(IndexError):
            ingest.picked(df, "at", wrong)
    with pytest.raises(IndexError):
        ingest.picked(df.limit(0), "at", [0])
    assert ingest.picked(df.limit(0), "at", []).count() == 0


def test_soft_drop_keeps_a_share(spark):
    rows = [(f"s{k}", "q", "a", [list(range(6)), [0, 1, 2, 3, 4]]) for k in range(400)]
    df = spark.createDataFrame(rows, "sample_id string, question string, gt_ans string, final_valid_transitions array<array<int>>")
    n = lambda **k: records.training_examples(df, 6, **k).filter("is_original_path").count()
    assert n() == 400 and n(drop_original=True) == 0 and n(drop_original=True, keep_probability=1.0) == 400
    some = n(drop_original=True, keep_probability=0.25)
    assert 60 < some < 140 and some <= n(drop_original=True, keep_probability=0.5)


def test_large_files_and_pointers_are_fingerprinted(spark, tmp_path):
    import hashlib

    big = tmp_path / "model-00001-of-00002.bin"
    with big.open("wb") as f:
        for k in range(65):
            f.write(bytes([k]) * (1 << 20))
    (tmp_path / "pointer.bin").write_bytes(b"version https://git-lfs.github.com/spec/v1\noid sha256:00\nsize 1\n")
    (tmp_path / "empty.json").write_bytes(b"")
    inv = readers.file_inventory(spark, str(tmp_path))
    rows = {r.file: r for r in inv.collect()}
    assert rows[big.name].sha256 == hashlib.sha256(big.read_bytes()).hexdigest() and rows[big.name].bytes == 65 << 20
    quick = {r.file: r.sha256 for r in readers.file_inventory(spark, str(tmp_path), hashed=r".*\.json").collect()}
    assert quick[big.name] is None and quick["empty.json"]
    errors = {tuple(r) for r in readers.snapshot_errors(inv, [big.name, "model-00002-of-00002.bin"]).collect()}
    assert errors == {("pointer.bin", "pointer"), ("empty.json", "empty"), ("model-00002-of-00002.bin", "missing")}


def test_arithmetic_answers(spark):
    texts = ["3", "3.0", "3.5", "1/2+1/2", "2**3", "(1+2)*4/6", "1/3", "7//2", "__import__('os')", "1/0", "2**9999999999", "", None, "abc", "9" * 150, "-(4)"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i for r in df.filter(readers.is_integer_answer(F.col("t"))).collect()}
    assert {texts[i] for i in got} == {"3", "3.0", "1/2+1/2", "2**3", "(1+2)*4/6", "7//2", "9" * 150, "-(4)"}


def test_a_sound_run_breaks_no_rule(spark):
    full = list(range(28))
    m = spark.createDataFrame([("a", "q", "1", 1, "train", 0, 0, "s/1")], "sample_id string, question string, gt_ans string, difficulty int, split string, position int, global_index int, source_query_id string")
    s = m.withColumns({"config_id": F.lit("c"), "status": F.lit("complete"), "failure_reason": F.lit(""), "initial_score": F.lit(1.0), "final_valid_transitions": F.array(F.array(*map(F.lit, full))), "final_invalid_transitions": F.array().cast("array<array<int>>"), "evaluations": F.array(F.struct(F.array(*map(F.lit, full)).alias("path"), F.lit(1.0).alias("score"))), "search_statistics": F.struct(F.lit(1).alias("unique_evaluations"))})
    c = spark.createDataFrame([(full, ["x"], 28)], "path array<int>, sources array<string>, length int").withColumn("candidate_id", paths.path_id(F.col("path")))
    u = c.select(F.lit("b").alias("sample_id"), F.lit("test").alias("split"), F.lit("complete").alias("status"), F.lit(1.0).alias("baseline_score"), F.create_map("candidate_id", F.lit(1.0)).alias("scores"), F.lit("").alias("failure_reason"))
    assert records.validated(m, s, u, c).collect() == []
    bad = {(r.stage, r.rule): r.n for r in records.validated(m, s.withColumn("question", F.lit("other")).withColumn("status", F.lit("failed")), u, c).collect()}
    assert bad == {("source", "question"): 1, ("record", "failed_without_reason"): 1, ("merge", "failed"): 1}


def test_indexed_neighbours(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(30, 16))
    x = middle[rng.integers(0, 30, 1500)] + 0.3 * rng.normal(size=(1500, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(9999, None)], "vec_id long, vec array<double>")
    q = df.filter("vec_id % 20 = 0 or vec_id = 9999")
    exact = {(r.query_id, r.neighbor_id, r.rank) for r in geometry.nearest(df, q, 5).collect()}
    pairs = lambda s: {x[:2] for x in s}
    found = {(r.query_id, r.neighbor_id, r.rank) for r in geometry.nearest_indexed(df, q, 5, probes=0.15).collect()}
    assert len(exact) == 375 and len(pairs(found) & pairs(exact)) >= 0.95 * len(exact)
    assert {(r.query_id, r.neighbor_id, r.rank) for r in geometry.nearest_indexed(df, q, 5, lists=7, probes=1.0, fit_rows=100).collect()} == exact
    assert geometry.nearest_indexed(df.limit(0), q, 5).count() == 0 and geometry.nearest_indexed(df, q.limit(0), 5).count() == 0


def test_bootstrap_by_counts_agrees_with_single_draws(spark):
    rows = [("test", "c", float(k % 3 == 0), float(k % 2 == 0)) for k in range(300)] + [("validation", "c", 1.0, 1.0)]
    df = spark.createDataFrame(rows, "split string, candidate_id string, baseline double, score double")
    one, many = ({r.split: (r.gain_low, r.gain_high) for r in f(df, 1000).collect()} for f in (transfer.bootstrap, transfer.bootstrap_counts))
    assert one["validation"] == many["validation"] == (0.0, 0.0)
    assert all(abs(a - b) < 0.03 for a, b in zip(one["test"], many["test"], strict=True)) and many["test"][0] < 1 / 6 < many["test"][1]
    assert {r.split: (r.gain_low, r.gain_high) for r in transfer.bootstrap_counts(df.repartition(5), 1000).collect()} == many
    assert transfer.bootstrap_counts(df.limit(0)).count() == 0
