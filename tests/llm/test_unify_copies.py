import sys
import unicodedata

from pathloom.llm import copies, unify
from pathloom.llm.text import form

TEXTS = [
    None, "", "  ", "​", "plain text", "plain \t text ", "ｐｌａｉｎ text", "Ｐlain‍ text", "café", "café", "cafe​́", "cа́fe", "ﬁsh", "f‍ish", "ḍ̇", "ḍ̇", "x− 1", "x- 1", "αβ", "Αβ", "a\n\nb", "a 　b", "漢字 e\U0001d400", "ấ", "ấ", "ạ̈", "ѐ", "é" * 3000, "A" * 20000 + "́",
]


def test_relational_form_equals_the_plain_one(spark):
    df = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(TEXTS)], "id bigint, text string, form string")
    got = {r.id: r.form for r in unify.consistent_form(df, ["id"]).collect()}
    assert set(got) == set(range(len(TEXTS)))
    for i, t in enumerate(TEXTS):
        assert (got[i] is None) == (t is None)
        if t is not None:
            assert got[i] == form(t), ascii(t)


def test_relational_form_equals_the_plain_one_on_all_of_unicode(spark):
    chars = [c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) not in ("Cs", "Co", "Cn")]
    apart = lambda c: unicodedata.normalize("NFD", c)
    kinds = [lambda c: c, apart, lambda c: "\u200b".join(apart(c)) + "\u200b", lambda c: c + "\u0301", lambda c: f"x{c}\u0323\u0308", lambda c: apart(c) + "\u200d\u0308\u0323"]
    texts = ["|".join(map(kind, chars[lo : lo + 100])) for lo in range(0, len(chars), 100) for kind in kinds]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r.id: r.form for r in unify.consistent_form(df, ["id"]).collect()}
    wrong = [(ascii(a), ascii(b)) for i, t in enumerate(texts) for a, b in zip(got[i].split("|"), form(t).split("|"), strict=False) if a != b]
    assert not wrong, (len(wrong), wrong[:20])
    assert all(got[i] == form(t) for i, t in enumerate(texts))


def test_vowel_signs_that_compose_without_a_mark(spark):
    texts = ["\u0995\u09cb", "\u0995\u09c7\u09be", "\u0995\u09cb\u200b", "\u0995\u09c7\u200b\u09be", "\u0dd9\u0dcf\u0dca", "\u0ddd", "\u0cca\u0cd5 \u0cc6\u0cc2\u0cd5"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    got = {r.id: r.form for r in unify.consistent_form(df, ["id"]).collect()}
    assert got == {i: form(t) for i, t in enumerate(texts)}
    assert len({got[k] for k in range(4)}) == 1 and got[4] == got[5] and len(set(got[6].split())) == 1
    twins = spark.createDataFrame([("a", k, t) for k, t in enumerate(texts[:4])], "tab string, id bigint, text string")
    assert {tuple(r) for r in unify.hidden_twins(twins).collect()} == {("a", i, j) for j in range(4) for i in range(j)}


def test_hangul_letters_and_syllables_are_one_form(spark):
    whole = ["\ud55c\uad6d\uc5b4 \uac00 \uac01 x\u0301 \ud7a3", "\uac00\uac01"]
    texts = [*whole, *(unicodedata.normalize("NFD", t) for t in whole), "\uac00\u11a8", "\uac01\u11a8", "\u1100 \u1161", "\u1100\u0301\u1161"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    assert {r.id: r.form for r in unify.consistent_form(df, ["id"]).collect()} == {i: form(t) for i, t in enumerate(texts)}
    twins = spark.createDataFrame([("a", 1, whole[0]), ("a", 2, texts[2])], "tab string, id bigint, text string")
    assert {tuple(r) for r in unify.hidden_twins(twins).collect()} == {("a", 1, 2)}


def test_twins(spark):
    rows = [("a", 1, "cafe x"), ("a", 2, "cafe  x"), ("a", 3, "c\u0430fe x"), ("b", 4, "c\u0430fe x"), ("a", 5, "Cafe x"), ("a", 6, None), ("a", 7, "\u200b"), ("a", 8, " "), ("a", 3, "c\u0430fe x")]
    df = spark.createDataFrame(rows, "tab string, id bigint, text string")
    assert {tuple(r) for r in unify.hidden_twins(df).collect()} == {("a", 1, 3), ("a", 2, 3)}
    assert unify.hidden_twins(df.limit(0)).count() == 0


def test_suspects_are_told_apart(spark):
    import re

    df = spark.createDataFrame([(t,) for t in TEXTS if t], "t string")
    for r in df.select("t", df.t.rlike(unify.SUSPECT).alias("s")).collect():
        changed = form(r.t) != re.sub("[ \t\n\r]+", " ", r.t).strip(" ")
        assert r.s or not changed, ascii(r.t[:50])


def test_canonical_records():
    a = copies.canonical_record('{"q": "A b.", "n": 3, "m": {"x": [1, "Y"], "w": null}}')
    assert a == copies.canonical_record('{ "m":{"w":null,"x":[1.0,"y"]}, "n":3.0, "q":"\\u0041B" }')
    assert a != copies.canonical_record('{"q": "A b.", "n": 4, "m": {"x": [1, "Y"], "w": null}}')
    assert copies.canonical_record('{"n": 1}') != copies.canonical_record('{"n": "1"}') != copies.canonical_record('{"n": true}')
    for bad in ("", "{", '{"a": NaN}', "[" * 100_000):
        assert copies.canonical_record(bad) is None


def test_copy_pairs_with_a_hot_set(spark):
    rows = [("t", i, "Hot text!" if i % 3 == 0 else f"cold {i}", False) for i in range(1, 400)] + [("u", 5, "hot-text", False), ("u", 6, "HOT  text.", False), ("j", 1, '{"a":"x y"}', True), ("j", 2, '{"a": "XY"}', True), ("j", 3, "{", True), ("j", 4, "{", True), ("t", 1000, None, False), ("t", 1001, "...", False), ("t", 3, "hot text", False)]
    df = spark.createDataFrame(rows, "tab string, id bigint, text string, is_json boolean")
    got = {tuple(r) for r in copies.copy_pairs(df).collect()}
    assert got == {("t", 3, i) for i in range(6, 400, 3)} | {("j", 1, 2)}
    sizes = {(r.tab, r.keep_id): r.n_copies for r in copies.collapsed(copies.canonical_hashes(df)).collect()}
    assert sizes["t", 3] == 133 and sizes["u", 5] == 1 and sizes["j", 1] == 2
    assert copies.copy_pairs(df.limit(0)).count() == 0
