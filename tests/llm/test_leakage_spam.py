import math
import random
from fractions import Fraction

import pytest

from pathloom.llm import leakage, spam
from pathloom.llm.text import words


def _brute(docs, items, span):
    grams = {}
    for i, t in items:
        w = words(t or "")
        for k in range(len(w) - span + 1):
            grams.setdefault(tuple(w[k : k + span]), set()).add(i)
    out = set()
    for d, t in docs:
        w = words(t or "")
        for k in range(len(w) - span + 1):
            out |= {(d, i) for i in grams.get(tuple(w[k : k + span]), ())}
    return out


@pytest.mark.parametrize("span", [3, 12])
def test_leaks_equal_brute_force(spark, span):
    rng = random.Random(span)
    vocab = [f"v{k}" for k in range(12)] + ["the"] * 6
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for i in range(40)] + [(90, None), (91, ""), (92, "the " * 30)]
    docs = []
    for d in range(120):
        w = rng.choices(vocab + ["x", "y"], k=rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            t = rng.choice(items[:40])[1].split()
            a = rng.randrange(len(t))
            w[len(w) // 2 : len(w) // 2] = t[a : a + rng.randint(1, 30)]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "the " * 5000), (503, items[0][1].upper() + ".")]
    got = leakage.leaked_pairs(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string"), span)
    assert {tuple(r) for r in got.collect()} == _brute(docs, items, span)


def test_longest_phrase_and_empty_sides(spark):
    item = " ".join(f"a{k}" for k in range(30))
    docs = spark.createDataFrame([(1, "x " + item + " y"), (2, " ".join(item.split()[5:19])), (3, " ".join(item.split()[5:16]))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, item)], "item_id bigint, text string")
    rows = {(r.doc_id, r.doc_pos, r.item_pos, r.n_words) for r in leakage.leaks(docs, items).collect()}
    assert rows == {(1, 1, 0, 30), (2, 0, 5, 14)}
    assert leakage.leaked_pairs(docs.limit(0), items).count() == 0
    assert leakage.leaked_pairs(docs, items.limit(0)).count() == 0


def _brute_near(docs, items, span, within, share):
    """The definition of near_matches by looking at every word of every document."""
    coded = {d: words(t or "") for d, t in docs}
    vocab = {}
    for _, t in items:
        if len(words(t or "")) >= span:
            for x in words(t):
                vocab.setdefault(x, len(vocab))
    count = {x: sum(w.count(x) for w in coded.values()) for x in vocab}
    out = {}
    for i, t in items:
        t = words(t or "")
        for at in {*range(0, len(t) - span + 1, max(span // 2, 1)), len(t) - span} if len(t) >= span else ():
            own = sorted(set(t[at : at + span]), key=lambda x: (count[x], vocab[x]))
            least = math.ceil(len(own) * share)
            for d, w in coded.items():
                for p, x in enumerate(w):
                    if x in own[: len(own) - least + 1]:
                        n = len(set(own) & set(w[max(0, p - within) : p + within + 1]))
                        if n >= least:
                            out[d, i] = max(out.get((d, i), 0), n)
    return out


@pytest.mark.parametrize("span", [4, 12])
def test_near_leaks_equal_brute_force(spark, span):
    rng = random.Random(span)
    vocab = [f"v{k}" for k in range(60)] + ["the"] * 6
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 40)))) for i in range(20)] + [(90, None), (91, "")]
    docs = []
    for d in range(60):
        w = rng.choices([*vocab, "x", "y"], k=rng.randint(0, 60))
        t = rng.choice(items[:20])[1].split()
        rng.shuffle(t)
        w[len(w) // 2 : len(w) // 2] = [y for x in t for y in ([x, "gap"] if rng.random() < 0.2 else [x])]
        docs.append((d, " ".join(w)))
    docs += [(500, None), (501, ""), (502, "the " * 3000)]
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    got = {(r.doc_id, r.item_id): r.n_terms for r in leakage.near_leaks(*args, span, 9, Fraction(3, 4)).collect()}
    assert got == _brute_near(docs, items, span, 9, 0.75)
    assert leakage.near_leaks(args[0].limit(0), args[1]).count() == 0 and leakage.near_leaks(args[0], args[1].limit(0)).count() == 0


def test_an_edit_in_every_run_leaves_a_proximity_match(spark):
    item = [f"a{k}" for k in range(30)]
    edited = " ".join(x + "z" if k % 8 == 5 else x for k, x in enumerate(item))
    docs = spark.createDataFrame([(1, "x " + edited), (2, " ".join(item)), (3, " ".join(x for y in zip(item, ["gap " * 30] * 30, strict=True) for x in y))], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, "b", "test", " ".join(item))], "item_id bigint, benchmark string, split string, text string")
    assert {tuple(r) for r in leakage.leaked_pairs(docs, items).collect()} == {(2, 7)}
    assert {r.doc_id for r in leakage.near_leaks(docs, items).collect()} == {1, 2}
    assert [tuple(r) for r in leakage.leak_report(leakage.leaks(docs, items), items, leakage.near_leaks(docs, items)).collect()] == [(7, "b", "test", 1, 30, 1)]
    exact, near = leakage.leaks_and_near(docs, items)
    assert [tuple(r) for r in leakage.leak_report(exact, items, near).collect()] == [(7, "b", "test", 1, 30, 1)]
    none = leakage.leaks_and_near(docs.limit(0), items)
    assert [tuple(r) for r in leakage.leak_report(none[0], items, none[1]).collect()] == [(7, "b", "test", 0, 0, 0)]


def test_items_beyond_the_bound_are_taken_in_parts(spark, monkeypatch):
    rng = random.Random(5)
    items = [(i, " ".join(f"t{rng.randrange(300)}" for _ in range(30))) for i in range(12)] + [(50, " ".join(f"u{k}" for k in range(200)))]
    docs = [(d, "x " + items[d % 13][1] + " y") for d in range(40)]
    args = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    monkeypatch.setattr(leakage, "MOST_ITEM_WORDS", 100)
    parts = list(leakage.item_parts(args[1]))
    assert len(parts) >= 5 and sorted(i for p in parts for i, _ in p) == [i for i, _ in items]
    assert {tuple(r) for r in leakage.leaked_pairs(*args).collect()} == _brute(docs, items, 12)


SENTENCES = "The gardener counted 45 plum trees near the river before noon. Then the baker sold 12 loaves to the miller, who paid 30 coins. How many loaves remain if each basket holds 7 of them? "
SPAM = {
    1: "\n".join(f"- https://site{k}.example/page-{k}.html" for k in range(12)),
    2: "\n".join(f'<a href="http://www.shop{k}.test/p?id={k}">solver</a>\nkit' for k in range(10)),
    3: ", ".join(f"#graph{k}, tag:ruler_{k}, solverbest" for k in range(12)),
    4: "\n".join(f"Home > tools > blue ruler SKU-{1000 + k} {k}.50 coins in stock" for k in range(8)),
    5: ", ".join(f"cheap tutor Town{k}" for k in range(25)),
    6: "best tutor in exam tutor new tutor and tutor price tutor for exam tutor deal tutor your tutor fast tutor with exam tutor new tutor",
    7: "\n".join(["eraser", "#stylus", "notebook", "tag:ruler", "stylus_blue"] * 6),
    8: SENTENCES + "\n" + ", ".join(f"cheap tutor Town{k}" for k in range(60)),
}
GOOD = {
    20: SENTENCES * 3,
    21: SENTENCES * 3 + "\nReferences\n" + "\n".join(f"https://site{k}.example/" for k in range(12)),
    22: SENTENCES + "\nTags: exam, course, coaching, flashcards, answers, worksheet",
    23: "\n".join(f"step {k} layer {k % 28} skip score 1.0 sec {k}.5 sample Lumarin" for k in range(40)),
    24: "\n".join(f"3 x {k} = {3 * k if k % 2 else '____'}" for k in range(2, 30)),
    25: "Hint", 26: "Answer: 42", 27: None, 28: "", 29: "See https://site.example/ for more.", 30: SENTENCES.replace("loaves", "tutor").replace("trees", "tutor"),
}


def test_spam_is_told_from_text(spark):
    rows = [(i, t, f"https://host{i}.example/x", "s") for i, t in {**SPAM, **GOOD}.items()] + [(60, SPAM[1], None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, url string, source string")
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == {*SPAM, 60}
    assert spam.spam_pages(df.limit(0)).count() == 0


def test_short_pages_of_several_lines_can_be_spam(spark):
    urls = [f"https://site{k}.example/" for k in range(6)]
    texts = ["\n".join(urls), "\n".join(f"#tag{k}" for k in range(5)), urls[0], " \n" + urls[0] + "\n\n", "Plums\nin the spring"]
    df = spark.createDataFrame([(i, t, None, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, url string, source string")
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == {0, 1}


def test_varied_phrases_on_many_hosts_are_spam(spark):
    parts = [" ".join(f"part{k}w{x}" for x in range(20)) for k in range(3)]
    stitched = " ".join(parts)  # no word twice
    assert spam.page_evidence(stitched)[2][0][1] == 0
    rows = [(1, stitched, "https://host1.example/"), (2, stitched.replace("part", "lone"), "https://host2.example/")]
    # two more hosts, where the phrases stand in ordinary sentences
    rows += [(10 + 10 * h + k, SENTENCES * 2 + f"The shop writes {p} on its page. " + SENTENCES, f"https://other{h}.example/") for h in range(2) for k, p in enumerate(parts)]
    # wrapped sentences that were crawled on many hosts
    wrapped = "In spring forty plates for every quiet house near that broad river came from old\nmiller Tom. Then a baker sold twelve loaves to him."
    rows += [(50 + k, wrapped, f"https://copy{k}.example/") for k in range(3)]
    df = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, url string, source string")
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == {1}


def test_phrases_on_many_hosts_decide_unclear_windows(spark):
    calm = " ".join(f"word{k}" for k in range(26)) + " word1 word2 word3 word4 word5"
    n, listed, windows = spam.page_evidence(calm)
    assert listed == 0 and windows[0][1] < spam.SURE
    df = spark.createDataFrame([(i, calm, f"https://host{i}.example/", "s") for i in range(spam.HOSTS)] + [(50, calm.replace("word", "lone"), "https://one.example/", "s")], "doc_id bigint, text string, url string, source string")
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == set(range(spam.HOSTS))


def _stuffed(rng, lead, words):
    """Keyword stuffing cut by full stops, so that every piece looks like a sentence."""
    out = []
    for k in range(60):
        out.append(f"{rng.choice(words)} {lead} {rng.choice(['with', 'for', 'and', 'in'])} {rng.choice(words)} {lead}" + ("." if k % 3 == 2 else ""))
    return " ".join(out)


def test_full_stops_do_not_hide_stuffing(spark):
    rng = random.Random(3)
    some = ["buy", "cheap", "new", "best", "review", "order", "price", "fast"]
    pages = {1: _stuffed(rng, "ruler", some), 2: SENTENCES + "\n" + _stuffed(rng, "tutor", some), 3: "\n".join(_stuffed(rng, "app", some).split(". "))}
    calm = {10: SENTENCES * 3 + " ".join(f"Tom{k} gave the tutor {k} coins for a lesson in spring." for k in range(20)), 11: "Chaque élève de Langham mesure 61.4 mètres de corde près de 62 étoiles."}
    df = spark.createDataFrame([(i, t, f"https://h{i}.example/", "s") for i, t in (pages | calm).items()], "doc_id bigint, text string, url string, source string")
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == set(pages)


def test_frames_with_masked_keywords_are_counted_over_hosts(spark):
    # Each page stuffs its own keyword into the same phrases, once each: little repetition, but the frames stand on many hosts.
    own = [f"word{x}" for x in range(60)]
    page = lambda lead: " ".join(f"{own[3 * k]} {own[3 * k + 1]} {lead} {own[3 * k + 2]} {lead}" for k in range(3)) + " " + " ".join(own[30:38])
    texts = {k: page(f"key{k}") for k in range(4)} | {50: page("solo").replace("word", "lone")}
    assert all(w[1] < spam.SURE for t in texts.values() for w in spam.page_evidence(t)[2])
    df = spark.createDataFrame([(i, t, f"https://h{i}.example/", "s") for i, t in texts.items()], "doc_id bigint, text string, url string, source string")
    scores = {r.doc_id: r for r in spam.spam_scores(df).collect()}
    assert all(scores[k].repeated_words == 0 and scores[k].replicated_words > 0 for k in range(4)) and scores[50].replicated_words == 0
    assert {r.doc_id for r in spam.spam_pages(df).collect()} == set(range(4))
