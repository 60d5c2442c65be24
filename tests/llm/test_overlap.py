import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from pathloom.llm import codes, neardup, overlap
from pathloom.llm.text import words


def brute(rows, num=7, den=10):
    """All (tab, a, b) whose bare texts differ and whose words agree."""
    out = set()
    ws = {(t, i): words(x) for t, i, x in rows if x and words(x)}
    for (t, i), a in ws.items():
        for (u, j), b in ws.items():
            if t == u and i < j and "".join(a) != "".join(b):
                common = sum((Counter(a) & Counter(b)).values())
                if den * common >= num * max(len(a), len(b)):
                    out.add((t, i, j))
    return out


def corpus(n, seed, lengths):
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rows[rng.randrange(len(rows))][2].split()
            for _ in range(rng.randint(0, max(1, len(w) // 3))):
                k = rng.randrange(len(w))
                w[k : k + 1] = rng.choice([[], [rng.choice(vocab)], [w[k], rng.choice(vocab)]])
                w = w or ["x"]
            if rng.random() < 0.3:
                rng.shuffle(w)
        else:
            w = rng.choices(vocab, weights=[1 / (k + 1) for k in range(400)], k=rng.choice(lengths))
        rows.append((rng.choice("ab"), i, " ".join(w)))
    return rows


@pytest.mark.parametrize("lengths", [[1, 2, 3, 5, 8], [12, 14, 16, 20], [50, 64, 80], [140, 160, 700]])
def test_all_pairs_are_found(spark, lengths):
    n = 150 if max(lengths) < 200 else 60
    rows = corpus(n, sum(lengths), lengths) + [("a", 9000, None), ("a", 9001, ""), ("b", 9002, " \t")]
    df = spark.createDataFrame([(t, i, 0, x) for t, i, x in rows], "tab string, id bigint, side int, text string")
    got = {tuple(r) for r in neardup.near_duplicates(df).collect()}
    assert got == brute(rows)


def test_copies_and_repeated_rows(spark):
    base = " ".join(f"w{k}" for k in range(40))
    rows = [("a", i, 0, base) for i in range(30)] + [("a", 100 + i, 0, base.replace("w1 ", "zz ")) for i in range(5)] + [("a", 100, 0, base.replace("w1 ", "zz "))]
    df = spark.createDataFrame(rows, "tab string, id bigint, side int, text string")
    got = {tuple(r) for r in neardup.near_duplicates(df).collect()}
    assert got == {("a", i, 100 + j) for i in range(30) for j in range(5)}


def test_empty_table(spark):
    df = spark.createDataFrame([], "tab string, id bigint, side int, text string")
    assert neardup.near_duplicates(df).count() == 0
    assert neardup.cross_split_pairs(df).count() == 0


def test_long_runs_are_cut_into_blocks(spark, monkeypatch):
    rows = corpus(120, 5, [20, 25])
    df = spark.createDataFrame([(t, i, i % 2, x) for t, i, x in rows], "tab string, id bigint, side int, text string")
    tokens = overlap.written_tokens(df)
    count = overlap.rarity(tokens)
    t = Fraction(7, 10)
    found = lambda cross: {tuple(r) for r in overlap.match_keys(overlap.packed_keys(tokens, count, 3, t), 3, t, cross).collect()}
    whole = found(False), found(True)
    monkeypatch.setattr(overlap, "RUN_BLOCK", 2)
    assert whole == (found(False), found(True)) and whole[1] < whole[0]


def test_keys_of_frequent_tokens_and_long_texts_are_split(spark, monkeypatch):
    rows = corpus(80, 6, [20, 60, 160])
    df = spark.createDataFrame([(t, i, 0, x) for t, i, x in rows], "tab string, id bigint, side int, text string")
    monkeypatch.setattr(overlap, "ROUTE_ROWS", 2)
    monkeypatch.setattr(overlap, "SLICE_TOKENS", 100)
    assert {tuple(r) for r in neardup.near_duplicates(df).collect()} == brute(rows)


def test_keys_are_estimated_from_lengths(spark):
    rows = corpus(200, 9, [3, 20, 60, 120, 400])
    df = spark.createDataFrame([(t, i, 0, x) for t, i, x in rows], "tab string, id bigint, side int, text string")
    tokens = overlap.written_tokens(df).cache()
    keys = 0
    for r in tokens.collect():
        keys += len(overlap.batch_keys(np.frombuffer(r.tok, np.uint32), np.array([r.n]), np.zeros(1, np.uint8), np.zeros(1 << overlap.RARITY_BITS, np.int32), Fraction(7, 10))[0])
    assert 0.8 < overlap.key_count(tokens, Fraction(7, 10)) / keys < 1.25


def test_cross_split(spark):
    rows = corpus(150, 77, [50, 64, 80])
    side = {i: i % 3 == 0 for _, i, _ in rows}
    df = spark.createDataFrame([("m", i, int(side[i]), x) for _, i, x in rows], "tab string, id bigint, side int, text string")
    near = {(a, b) for _, a, b in brute([("m", i, x) for _, i, x in rows]) if side[a] != side[b]}
    bare = {}
    for _, i, x in rows:
        bare.setdefault("".join(words(x)), []).append(i)
    same = {(a, b) for ids in bare.values() for a in ids for b in ids if a < b and side[a] != side[b]}
    got = {tuple(r) for r in neardup.cross_split_pairs(df).collect()}
    assert {tuple(r) for r in neardup.cross_split_pairs(df, exact=True).collect()} == near | same
    assert got <= near | same
    assert len(got) >= 0.99 * len(near | same)
    assert same <= got


def test_prefix_keys_cover_every_match():
    rng = random.Random(3)
    t = Fraction(7, 10)
    count = np.zeros(1 << overlap.RARITY_BITS, np.int32)
    for n in (1, 3, 14, 15, 16, 21, 149, 150, 213, 300):
        for _ in range(6):
            a = [rng.randrange(1 << 32) for _ in range(n)]
            m = rng.randint(n, int(n / 0.7))
            common = rng.sample(a, min(n, int(overlap.need(m, t))))
            if len(common) < overlap.need(m, t):
                continue
            b = common + [rng.randrange(1 << 32) for _ in range(m - len(common))]
            tok = np.array(a + b, np.uint32)
            row, key, route = overlap.batch_keys(tok, np.array([n, m]), np.zeros(2, np.uint8), count, t)
            both = set(zip(key[row == 0].tolist(), route[row == 0].tolist(), strict=True)) & set(zip(key[row == 1].tolist(), route[row == 1].tolist(), strict=True))
            assert both, (n, m)


def test_sketch_distance_is_bounded_by_difference():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, 60, dtype=np.uint32)
    b = np.r_[a[:50], rng.integers(0, 1 << 32, 15, dtype=np.uint32)]
    s = overlap._sketches(np.r_[a, b], np.repeat([0, 1], [60, 65]), 2)
    assert np.bitwise_count(s[0] ^ s[1]).sum() <= 25


def _pairs_at(n, m, common, pairs, rng):
    """(tokens, lengths) of ``pairs`` pairs of texts with n and m words, ``common`` of them the same."""
    x = rng.integers(0, 1 << 32, (pairs, n + m - common), dtype=np.uint32)
    both = np.concatenate([x[:, :n], x[:, n - common :]], axis=1)
    return both.ravel(), np.tile([n, m], pairs)


def test_blocks_meet_at_the_threshold():
    count, t = np.zeros(1 << overlap.RARITY_BITS, np.int32), Fraction(7, 10)
    for n, m, common in ((10, 10, 7), (20, 20, 14), (40, 40, 28), (14, 20, 14), (30, 40, 29), (40, 40, 30), (100, 100, 70), (5, 5, 4)):
        tok, size = _pairs_at(n, m, common, 3000, np.random.default_rng(n * m))
        row, key, _ = codes.code_keys(tok, size, np.zeros(len(size), np.uint8), count, t)
        key = key[np.argsort(row, kind="stable")].reshape(3000, 2, -1)
        assert (key[:, 0] == key[:, 1]).any(axis=1).mean() >= 0.998, (n, m, common)


def test_copies_of_a_text_do_not_depend_on_the_number_of_texts():
    tok, size = _pairs_at(40, 40, 28, 500, np.random.default_rng(1))
    for seen in (0, 10**5, 10**12):  # how often each token comes in the whole collection
        row, key, route = codes.code_keys(tok, size, np.zeros(len(size), np.uint8), np.full(1 << overlap.RARITY_BITS, seen), Fraction(7, 10))
        assert (np.bincount(row) == codes.ANCHORS * codes.PARTNERS).all()
        most = codes.ANCHORS if seen < overlap.ROUTE_ROWS else codes.ANCHORS * codes.PARTNERS
        assert max(len(set(route[row == r])) for r in range(50)) <= most


def test_rare_edits_at_the_threshold_are_found(spark):
    rng = random.Random(3)
    rows = []
    for k in range(400):
        shared = rng.sample([f"w{x}" for x in range(60)], 14)
        rows += [("m", 2 * k + s, s, " ".join(shared + [f"r{k}s{s}e{x}" for x in range(6 - k % 2 * s)])) for s in (0, 1)]
    want = {(a, b) for _, a, b in brute([(t, i, x) for t, i, _, x in rows]) if (a + b) % 2}
    assert len(want) >= 400
    df = spark.createDataFrame(rows, "tab string, id bigint, side int, text string")
    found = {tuple(r) for r in neardup.cross_split_pairs(df).collect()}
    assert found <= want and len(want - found) <= 0.01 * len(want)
