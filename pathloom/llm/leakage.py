"""Problem 7: evaluation texts inside training texts, by a positional inverted index.

The index is partitioned by documents: each shard row holds, for a few thousand documents,
the positions of every term that occurs in the evaluation items. Document frequencies are
added up over all shards. For each item the rarest term of every window of ``span`` words is
an anchor; its offset-adjusted postings are intersected with those of the neighbouring
terms until runs of ``span`` consecutive words are proved or dead. Proximity matches come from
the same postings: around the rarest words of a block of an item, most of its words must stand
close by, in any order. A shard looks only at items whose anchors it has. Shards are independent,
so nothing is shuffled but term counts, and nothing grows with the corpus on the driver; items
beyond a bound are taken in parts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .text import words

#: Consecutive words that prove a leak (TESTDATA.md).
SPAN = 12
#: Documents of one index shard row, and words from which it ends sooner.
SHARD_DOCS, SHARD_WORDS = 2000, 2_000_000
#: Proven bound of the query side, which is sent to every task. More items are searched for in parts, each by an index of its own.
MOST_ITEM_WORDS = 5_000_000
#: Proximity: share of the different words of a block of SPAN item words, and how far from one of its rarest words they stand at most.
NEAR_SHARE, NEAR_WORDS = Fraction(3, 4), 18
_SHARD = "docs binary, terms binary, ends binary, postings binary"


def item_parts(items: DataFrame, span: int = SPAN) -> Iterator[list[tuple[int, list[str]]]]:
    """(item_id, words) of all items long enough to leak, in lists of at most MOST_ITEM_WORDS words (but one item at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, w) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True) if len(w := words(t)) >= span]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int64()), pa.array([w for _, w in rows], pa.list_(pa.string()))], names=["item_id", "words"])

    part, total = [], 0
    whole = items.filter("item_id is not null and text is not null").select(F.col("item_id").cast("bigint"), F.col("text").cast("string"))
    for r in whole.mapInArrow(run, "item_id bigint, words array<string>").toLocalIterator():
        if part and total + len(r.words) > MOST_ITEM_WORDS:
            yield part
            part, total = [], 0
        part.append((r.item_id, r.words))
        total += len(r.words)
    if part:
        yield part


def index_shards(documents: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """The positional index of ``documents``(doc_id, text): one row per shard.

    A posting is (document number in the shard, word position), 32 bits each, ascending.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def shard(ids: list[int], terms: list[int], lengths: list[int]) -> pa.RecordBatch:
        term, n = np.array(terms, dtype=np.int64), np.array(lengths, dtype=np.int64)
        start = np.repeat(np.cumsum(n) - n, n)
        post = (np.repeat(np.arange(len(n), dtype=np.uint64), n) << np.uint64(32)) | (np.arange(len(term)) - start).astype(np.uint64)
        term, post = term[term >= 0], post[term >= 0]
        order = np.argsort(term, kind="stable")
        own, count = np.unique(term, return_counts=True)
        row = (np.array(ids, np.int64).tobytes(), own.astype(np.int32).tobytes(), np.cumsum(count).astype(np.int64).tobytes(), post[order].tobytes())
        return pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], names=["docs", "terms", "ends", "postings"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            ids, terms, lengths = [], [], []
            for i, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                w = [get(x, -1) for x in words(text)]
                ids.append(i)
                terms.extend(w)
                lengths.append(len(w))
                if len(ids) == SHARD_DOCS or len(terms) >= SHARD_WORDS:
                    yield shard(ids, terms, lengths)
                    ids, terms, lengths = [], [], []
            if ids:
                yield shard(ids, terms, lengths)

    return documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, _SHARD)


def term_counts(shards: DataFrame, terms: int) -> np.ndarray:
    """Postings per term over all shards; as many numbers as the items have terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(terms, np.int64)
        for batch in batches:
            for t, e in zip(batch.column("terms").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                total[np.frombuffer(t, np.int32)] += np.diff(np.frombuffer(e, np.int64), prepend=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(terms, dtype=np.int32)), pa.array(total)], names=["term", "n"])

    out = np.zeros(terms, np.int64)
    got = shards.select("terms", "ends").mapInArrow(run, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("term").to_numpy()] = got.column("n").to_numpy()
    return out


def anchors(item: np.ndarray, counts: np.ndarray, span: int) -> list[int]:
    """Ascending offsets such that every window of ``span`` terms has one of its rarest terms among them, as few as a scan finds."""
    n, out = counts[item], []
    for lo in range(len(item) - span + 1):
        window = n[lo : lo + span]
        least = window.min()
        if not out or out[-1] < lo or n[out[-1]] > least:
            out.append(int(lo + span - 1 - np.argmin(window[::-1])))
    return out


def runs_at(post: list[np.ndarray], off: int, span: int, seed: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phrase matches through the anchor ``off`` of an item with postings ``post`` per offset; ``seed`` are those of the anchor.

    Returns the anchor postings that lie in a run of at least ``span`` matching words, and how
    many words match directly before and after each, counted up to ``most``.
    """
    reach = [np.zeros(len(seed), np.int64), np.zeros(len(seed), np.int64)]
    for side, sign in enumerate((-1, 1)):
        alive = np.arange(len(seed))
        for step in range(1, most + 1):
            o = off + sign * step
            if not 0 <= o < len(post) or not len(alive):
                break
            want = seed[alive] + np.uint64(step) if sign > 0 else seed[alive] - np.uint64(step)
            at = np.searchsorted(post[o], want)
            hit = at < len(post[o])
            hit[hit] = post[o][at[hit]] == want[hit]
            alive = alive[hit]
            reach[side][alive] = step
    ok = reach[0] + reach[1] + 1 >= span
    return seed[ok], reach[0][ok], reach[1][ok]


def phrase_matches(shards: DataFrame, items: list[tuple[int, np.ndarray]], counts: np.ndarray, span: int = SPAN, whole: bool = True) -> DataFrame:
    """(doc_id, item_id, doc_pos, item_pos, n_words): all longest shared phrases of at least ``span`` words.

    Without ``whole`` one phrase proves a document, and its length is counted near the anchor only.
    """
    plan = [(i, t, anchors(t, counts, span)) for i, t in items]
    by_term: dict[int, list[int]] = {}
    for k, (_, t, offs) in enumerate(plan):
        for x in set(t[offs].tolist()):
            by_term.setdefault(x, []).append(k)
    shared = shards.sparkSession.sparkContext.broadcast((plan, by_term))
    none = np.zeros(0, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, by_term = shared.value
        for docs, lists in _postings(batches):
            out = []
            for k in sorted({k for x in lists for k in by_term.get(x, ())}):
                item, t, offs = plan[k]
                own = [lists.get(int(x), none) for x in t]
                known, until = np.zeros(0, np.int64), np.zeros(0, np.int64)  # alignments with a run, and where it ends
                proved = none  # numbers of documents that need no further proof
                for off in offs:
                    seed = own[off]
                    if len(seed) and len(known):
                        align = seed.astype(np.int64) - off
                        at = np.minimum(np.searchsorted(known, align), len(known) - 1)
                        seed = seed[(known[at] != align) | (until[at] <= off)]
                    if len(seed) and len(proved):
                        seed = seed[~np.isin(seed >> np.uint64(32), proved)]
                    if len(seed):
                        hit, before, after = runs_at(own, off, span, seed, len(own) if whole else span - 1)
                        if len(hit) and not whole:
                            proved = np.unique(np.r_[proved, hit >> np.uint64(32)])
                        if len(hit):
                            known, until = np.r_[known, hit.astype(np.int64) - off], np.r_[until, off + after + 1]
                            order = np.lexsort((until, known))
                            known, until = known[order], until[order]
                            last = np.r_[known[1:] != known[:-1], True]
                            known, until = known[last], until[last]
                            doc = docs[(hit >> np.uint64(32)).astype(np.int64)]
                            at = (hit & np.uint64(0xFFFFFFFF)).astype(np.int64) - before
                            out.append(np.stack([doc, np.full(len(doc), item), at, off - before, before + after + 1], axis=1))
            if out:
                u = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, k]) for k in range(5)], names=["doc_id", "item_id", "doc_pos", "item_pos", "n_words"])

    return shards.mapInArrow(run, "doc_id bigint, item_id bigint, doc_pos bigint, item_pos bigint, n_words bigint")


def near_matches(shards: DataFrame, items: list[tuple[int, np.ndarray]], counts: np.ndarray, span: int = SPAN, within: int = NEAR_WORDS, share: Fraction = NEAR_SHARE) -> DataFrame:
    """(doc_id, item_id, doc_pos, item_pos, n_terms): proximity matches, also where no run of ``span`` words is whole.

    Blocks of ``span`` item words begin at every half span and end with the item. A block matches
    around one of its rarest words if at least ``share`` of its different words stand at most
    ``within`` words from there, in any order; so many of the rarest words are tried that a match
    can't lack all of them.
    """
    plan, by_term = [], {}
    for i, t in items:
        for at in sorted({*range(0, len(t) - span + 1, max(span // 2, 1)), len(t) - span}):
            own = np.unique(t[at : at + span])
            own = own[np.lexsort((own, counts[own]))]
            least = -(-len(own) * share.numerator // share.denominator)
            plan.append((i, at, own.tolist(), least))
            for x in own[: len(own) - least + 1].tolist():
                by_term.setdefault(x, []).append(len(plan) - 1)
    shared = shards.sparkSession.sparkContext.broadcast((plan, by_term))
    reach = np.uint64(within)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, by_term = shared.value
        for docs, lists in _postings(batches):
            out = []
            for k in sorted({k for x in lists for k in by_term.get(x, ())}):
                item, at, own, least = plan[k]
                have = [x for x in own if x in lists]
                if len(have) < least:
                    continue
                for lead in own[: len(own) - least + 1]:
                    seed = lists.get(lead)
                    if seed is None:
                        continue
                    found = np.zeros(len(seed), np.int64)
                    for done, x in enumerate(have):
                        post = lists[x]
                        low = np.maximum(seed & ~np.uint64(0xFFFFFFFF), seed - np.minimum(reach, seed & np.uint64(0xFFFFFFFF)))
                        first = np.searchsorted(post, low)
                        hit = first < len(post)
                        hit[hit] = post[first[hit]] <= seed[hit] + reach
                        found += hit
                        alive = found + (len(have) - done - 1) >= least
                        if not alive.all():
                            seed, found = seed[alive], found[alive]
                        if not len(seed):
                            break
                    if len(seed):
                        doc = docs[(seed >> np.uint64(32)).astype(np.int64)]
                        out.append(np.stack([doc, np.full(len(doc), item), (seed & np.uint64(0xFFFFFFFF)).astype(np.int64), np.full(len(doc), at), found], axis=1))
            if out:
                u = np.unique(np.concatenate(out), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, k]) for k in range(5)], names=["doc_id", "item_id", "doc_pos", "item_pos", "n_terms"])

    return shards.mapInArrow(run, "doc_id bigint, item_id bigint, doc_pos bigint, item_pos bigint, n_terms bigint")


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, dict[int, np.ndarray]]]:
    """(document ids, ascending postings by term) of each shard."""
    for batch in batches:
        for docs, terms, ends, postings in zip(*(batch.column(c).to_pylist() for c in ("docs", "terms", "ends", "postings")), strict=True):
            post, end = np.frombuffer(postings, np.uint64), np.frombuffer(ends, np.int64)
            yield np.frombuffer(docs, np.int64), {int(t): post[a:b] for t, a, b in zip(np.frombuffer(terms, np.int32), np.r_[0, end[:-1]], end, strict=True)} if len(end) else {}


def _in_parts(documents: DataFrame, items: DataFrame, span: int, search: Callable[..., DataFrame], schema: str) -> DataFrame:
    """``search``(shards, coded items, term counts) of each part of the items; the results of several parts are written."""
    spark, out, ahead = documents.sparkSession, [], None

    def one(part: list[tuple[int, list[str]]]) -> DataFrame:
        vocabulary: dict[str, int] = {}
        coded = [(i, np.array([vocabulary.setdefault(x, len(vocabulary)) for x in w], dtype=np.int32)) for i, w in part]
        shards = written(index_shards(documents, vocabulary), "shards")
        return search(shards, coded, term_counts(shards, len(vocabulary)))

    for part in item_parts(items, span):
        if ahead is not None:
            out.append(written(one(ahead), "matches"))
        ahead = part
    if ahead is not None:
        out.append(written(one(ahead), "matches") if out else one(ahead))
    return reduce(DataFrame.union, out) if out else spark.createDataFrame([], schema)


def leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, whole: bool = True) -> DataFrame:
    """All phrases of at least ``span`` words that documents share with items (see ``phrase_matches``).

    Rows without id or text are no case; texts shorter than ``span`` words can't match; an
    empty side gives no rows; a repeated row only repeats matches.
    """
    return _in_parts(documents, items, span, lambda *x: phrase_matches(*x, span, whole), "doc_id bigint, item_id bigint, doc_pos bigint, item_pos bigint, n_words bigint")


def near_leaks(documents: DataFrame, items: DataFrame, span: int = SPAN, within: int = NEAR_WORDS, share: Fraction = NEAR_SHARE) -> DataFrame:
    """(doc_id, item_id, n_terms): documents in which an item's words stand close together (see ``near_matches``), with the most that do.

    Rows without id or text, short texts, empty sides and repeated rows are treated as in ``leaks``.
    """
    found = _in_parts(documents, items, span, lambda *x: near_matches(*x, span, within, share), "doc_id bigint, item_id bigint, doc_pos bigint, item_pos bigint, n_terms bigint")
    return found.groupBy("doc_id", "item_id").agg(F.max("n_terms").alias("n_terms"))


def leaks_and_near(documents: DataFrame, items: DataFrame, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """(doc_id, item_id, n_words) of ``leaks`` and (doc_id, item_id, n_terms) of ``near_leaks`` from one index, written once."""
    pair = ["doc_id", "item_id"]
    both = lambda *x: phrase_matches(*x, span).select(*pair, "n_words", F.lit(0).alias("n_terms")).union(near_matches(*x, span).select(*pair, F.lit(0).alias("n_words"), "n_terms"))
    found = _in_parts(documents, items, span, both, "doc_id bigint, item_id bigint, n_words bigint, n_terms bigint")
    most = written(found.groupBy(*pair).agg(F.max("n_words").alias("n_words"), F.max("n_terms").alias("n_terms")), "leaks")
    return most.filter("n_words > 0").select(*pair, "n_words"), most.filter("n_terms > 0").select(*pair, "n_terms")


def leaked_pairs(documents: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id) that share at least ``span`` consecutive words."""
    return leaks(documents, items, span, whole=False).select("doc_id", "item_id").distinct()


def leak_report(matches: DataFrame, items: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """(item_id, benchmark, split, n_docs, longest, n_near): every item with the documents it leaked into, its longest matched phrase, and the further documents that have its words close together."""
    pairs = matches.groupBy("item_id", "doc_id").agg(F.max("n_words").alias("w"))
    per = pairs.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("w").alias("longest"))
    out = items.select("item_id", "benchmark", "split").join(per, "item_id", "left")
    if near is None:
        out = out.withColumn("n_near", F.lit(0))
    else:
        out = out.join(near.join(pairs, ["item_id", "doc_id"], "left_anti").groupBy("item_id").agg(F.count(F.lit(1)).alias("n_near")), "item_id", "left")
    return out.select("item_id", "benchmark", "split", *(F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_docs", "longest", "n_near")))
