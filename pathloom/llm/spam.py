"""Problem 8: keyword-stuffed pages, link lists and lists of tags or products.

Each page is cut into lines and windows of words. Lines of links, tags and product entries,
and runs of bare lines of a few words, are list evidence. Windows of words without real
sentences are judged twice. Phrase shingles: the distinct hosts of each phrase (five words) are
counted over all text of the whole crawl. Where one word leads the window, it is masked, so
that phrases stuffed with different keywords are one frame ("buy * and * *"); such a window is
stuffed if enough of its frames with two masks or more stand on several hosts, any other if
most of its phrases do. Repetition: a window in which few different words keep coming back is
stuffed, also where it is the only one of its kind. Full stops don't make a sentence of words
that one keyword leads. Only phrases of windows without sentences are shuffled: a table of
fixed size, which lets no phrase of them slip, sorts out the others before. A page is spam if
more than half of its words lie in such lines and windows.
"""

from __future__ import annotations

import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import written
from .overlap import _spread
from .text import MARKS, form, words

#: Words of a phrase shingle.
PHRASE = 5
#: Words of a window in which repetition is measured.
WINDOW = 60
#: Share of repeated words (1 - different / all) from which a window without sentences is stuffed by itself.
SURE = 0.3
#: Share of one word from which it leads a window or line, and from which words with a full stop that it leads are no sentence.
LEAD, LED = 0.2, 0.3
#: Repetition below which a window is a stray part of wrapped text, not keywords, where half of the page's words are in sentences.
STRAY = 0.1
#: Log2 of the places of the table of phrases that decide something.
TABLE_BITS = 22
#: Hosts on which a replicated phrase stands at least, and the share of them in a stuffed window, of frames in a led one.
HOSTS, REPLICATED, FRAMED = 3, 0.5, 0.15
#: Words of a window or of a page of one line at least; shorter one-liners are never spam.
LEAST_WORDS = 12
#: Words of a bare line at most, and how many such lines in a row are a list.
SHORT, LIST_RUN = 3, 5

_URL = re.compile(r"(?i)(?:https?://|www\.)\S+|(?<![\w.])(?:[a-z0-9-]+\.)+[a-z]{2,}(?:/\S*|(?=[\s\])>\"']|$))")
_DOMAIN = re.compile(r"(?i)\.[a-z]{2,}(?:[/\s\])>\"']|$)")
_TAG = re.compile(r"(?i)^(?:#|tag:)\w")
_PRODUCT = re.compile(r"(?i)\bsku\W?\d+|\S\s[>»›]\s\S+(?:\s\S+){0,3}\s[>»›]\s\S")
_TAGS = re.compile(r"^\s*#?\w{3,12}:(?:\s*[\w-]+\s*[,;]){3,}")
_SENTENCE = re.compile(r"(?<=[.!?…])[\"'”’)\]]*\s+")
_ENDED = re.compile(r"[.!?…][\"'”’)\]]*\s*$")
_SEPARATORS = str.maketrans(dict.fromkeys(string.punctuation + MARKS, " "))
_ASCII_SEPARATORS = bytes(32 if chr(k) in string.punctuation else k for k in range(256))
_NUMBER = re.compile(r"^[^A-Za-z]*\d[\d.,:/%x=_-]*$")


def line_kind(line: str, tokens: list[str]) -> str:
    """link, tag, product, short (a few bare words) or text."""
    if "://" in line or "www." in line or _DOMAIN.search(line):
        urls = len(_URL.findall(line))
        rest = len(_URL.sub(" ", re.sub(r"</?a\b|href=|[<>\[\]()\"*]", " ", line)).split())
        if urls and rest <= 3 * urls and not (rest >= 4 and _ENDED.search(line)):
            return "link"
    if "#" in line or "tag:" in line or ":" in tokens[0]:
        tags = sum(bool(_TAG.match(t)) for t in tokens)
        if tags and tags >= 0.25 * len(tokens) or _TAGS.match(line):
            return "tag"
    if (">" in line or "»" in line or "›" in line or "SKU" in line or "sku" in line) and _PRODUCT.search(line):
        return "product"
    return "short" if len(tokens) <= SHORT and not _ENDED.search(line) else "text"


def leader(tokens: list[str]) -> tuple[str, float]:
    """The most frequent word that is no number, and its share of all words; of several the one that comes first."""
    counts = Counter(tokens)
    word = max(counts, key=counts.get)
    if not any(map(str.isalpha, word)):
        word = next((x for x, _ in counts.most_common(8) if any(map(str.isalpha, x))), "")
    return word, counts[word] / len(tokens)


def _tokens(line: str) -> list[str]:
    """Runs of letters and digits in lower case, for counting only."""
    if line.isascii():  # a table of bytes is much faster
        return line.lower().encode("ascii").translate(_ASCII_SEPARATORS).decode("ascii").split()
    return line.lower().translate(_SEPARATORS).split()


def line_leader(tokens: list[str]) -> str:
    """The word that leads a line of some length, or nothing."""
    if len(tokens) < LEAST_WORDS or len(set(tokens)) > len(tokens) * (1 - LED) + 1:  # else no word can come that often
        return ""
    word, share = leader(tokens)
    return word if share >= LED else ""


def page_leader(tokens: list[str]) -> str:
    """The word that leads a whole page, or nothing."""
    word, share = leader(tokens) if len(tokens) >= LEAST_WORDS else ("", 0.0)
    return word if share >= LEAD else ""


def sentence_words(text: str, led: set[str] = frozenset()) -> int:
    """Words in real sentences: pieces of 4 to 60 words that end with a full stop, question or exclamation mark and that no word of ``led`` leads."""
    total = 0
    for piece in _SENTENCE.split(text):
        n = len(piece.split())
        if 4 <= n <= 60 and _ENDED.search(piece):
            w = _tokens(piece) if led else ()
            if not any(w.count(x) >= LED * len(w) for x in led):
                total += n
    return total


def page_sentences(text: str) -> int:
    """Words in real sentences of a whole page."""
    rows = [_tokens(x) for x in text.splitlines()]
    return sentence_words(text, {x for x in (page_leader([y for r in rows for y in r]), *map(line_leader, rows)) if x})


def page_evidence(text: str) -> tuple[int, int, list[tuple[int, float, list[str]]]]:
    """(words, words in lists, [(words, repetition, words in order) of each window without real sentences])."""
    lines, split = [], []
    for x in text.splitlines():
        x = x if x.isascii() else form(x)
        t = x.split()
        if t:
            lines.append(x)
            split.append(t)
    tokens = [_tokens(x) for x in lines]
    lead = page_leader([y for row in tokens for y in row])
    leads = [{x for x in (lead, line_leader(row)) if x} for row in tokens]
    kinds = [line_kind(x, t) for x, t in zip(lines, split, strict=True)]
    for k, kind in enumerate(kinds):  # bare words between links or tags belong to that list
        if kind == "short" and any(kinds[j] in ("link", "tag") for j in (k - 1, k + 1) if 0 <= j < len(kinds)):
            kinds[k] = "listed"
    k = 0
    while k < len(kinds):
        end = k
        while end < len(kinds) and kinds[end] in ("short", "listed", "link", "tag"):
            end += 1
        if end - k >= LIST_RUN:
            for j in range(k, end):
                if kinds[j] == "short" and not _NUMBER.match(lines[j]):
                    kinds[j] = "listed"
        k = max(end, k + 1)
    total = listed = 0
    windows, block = [], []

    def close() -> None:
        # one block: lines in a row of which none is mostly sentences
        size = sum(len(split[k]) for k in block)
        if size >= LEAST_WORDS and sentence_words("\n".join(lines[k] for k in block), set().union(*(leads[k] for k in block))) < 0.5 * size:
            w = [y for k in block for y in words(lines[k])]
            if len(w) >= LEAST_WORDS and sum(bool(_NUMBER.match(y)) for y in w) <= 0.2 * len(w):
                n = max(1, round(len(w) / WINDOW))
                cut = [len(w) * j // n for j in range(n + 1)]
                windows.extend((b - a, 1 - len(set(w[a:b])) / (b - a), w[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True))
        block.clear()

    for k, kind in enumerate(kinds):
        n = len(split[k])
        total += n
        if kind in ("link", "tag", "product", "listed"):
            listed += n
            close()
        elif 2 * sentence_words(lines[k], leads[k]) >= n:
            close()
        else:
            block.append(k)
    close()
    return total, listed, windows


_PAGE = "doc_id bigint, host bigint, n bigint, lines bigint, listed bigint, windows array<struct<n:int,repeats:boolean,least:double,phrases:array<bigint>>>"
#: Stands for the leading word in frames.
_MASK = np.uint64(0x5851F42D4C957F2D)


def _word_hashes(w: list[str], known: dict[str, int]) -> list[int]:
    out = list(map(known.get, w))
    if None in out:
        if len(known) > 300_000:
            known.clear()
        for k, h in enumerate(out):
            if h is None:
                out[k] = known[w[k]] = xxhash.xxh64_intdigest(w[k].encode("utf-8", "surrogatepass"))
    return out


def _runs_of(h: np.ndarray) -> np.ndarray:
    n = max(0, len(h) - PHRASE + 1)
    out = np.zeros(n, np.uint64)
    for k in range(PHRASE):
        out = _spread(out + h[k : k + n])
    return out.view(np.int64)


def _phrases(w: list[str], known: dict[str, int]) -> np.ndarray:
    """Hashes of all runs of PHRASE words."""
    return _runs_of(np.array(_word_hashes(w, known), np.uint64))


def _frames(w: list[str], lead: str, known: dict[str, int]) -> np.ndarray:
    """Hashes of all runs of PHRASE words in which ``lead`` stands twice or more and is masked."""
    h = np.array(_word_hashes(w, known), np.uint64)
    masked = np.array([x == lead for x in w], bool)
    h[masked] = _MASK
    count = np.convolve(masked, np.ones(PHRASE, np.int64), "valid") if len(w) >= PHRASE else np.zeros(0)
    return _runs_of(h)[count >= 2]


def _spelled(line: str) -> list[str]:
    """The words of a line that have letters or digits."""
    return [y for y in words(line) if y.isalnum() or any(map(str.isalnum, y))]


def _window(n: int, repetition: float, w: list[str], known: dict[str, int]) -> dict:
    """One window: whether it repeats itself, its phrases or frames, and how many of them must stand on several hosts."""
    w = [y for y in w if y.isalnum() or any(map(str.isalnum, y))]
    word, share = leader(w) if w else ("", 0.0)
    phrases = _frames(w, word, known) if share >= LEAD else _phrases(w, known)
    least = max(1.0, (FRAMED if share >= LEAD else REPLICATED) * max(len(w) - PHRASE + 1, 1))
    return {"n": n, "repeats": repetition >= SURE, "least": least, "phrases": phrases.tolist()}


def pages(documents: DataFrame) -> DataFrame:
    """Evidence of each page of ``documents``(doc_id, url, source, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            out = []
            for i, host, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "host", "text")), strict=True):
                n, listed, windows = page_evidence(text or "")
                if any(x[1] < STRAY for x in windows) and 2 * page_sentences(text if text.isascii() else form(text)) >= n:
                    windows = [x for x in windows if x[1] >= STRAY]
                lines = sum(not x.isspace() and x != "" for x in (text or "").splitlines())
                out.append({"doc_id": i, "host": host, "n": n, "lines": lines, "listed": listed, "windows": [_window(*x, known) for x in windows]})
            if out:
                kind = pa.struct([("n", pa.int32()), ("repeats", pa.bool_()), ("least", pa.float64()), ("phrases", pa.list_(pa.int64()))])
                types = {"doc_id": pa.int64(), "host": pa.int64(), "n": pa.int64(), "lines": pa.int64(), "listed": pa.int64(), "windows": pa.list_(kind)}
                yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in out], t) for c, t in types.items()], names=list(types))

    return _hosted(documents).mapInArrow(run, _PAGE)


def _hosted(documents: DataFrame) -> DataFrame:
    """(doc_id, host, text); the host is that of the url, or the source where there is none."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]+)", 1))
    host = F.xxhash64(F.when(host == "", F.coalesce(F.col("source"), F.lit(""))).otherwise(host))
    return documents.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("bigint"), host.alias("host"), F.col("text").cast("string"))


def phrase_hosts(documents: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(phrase, host) over all text of all pages, for phrases whose place in the table ``wanted`` is set; combined per batch."""
    shared = documents.sparkSession.sparkContext.broadcast(np.packbits(wanted))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = np.unpackbits(shared.value).view(bool), {}
        for batch in batches:
            found = [np.zeros((0, 2), np.int64)]
            for host, text in zip(batch.column("host").to_pylist(), batch.column("text").to_pylist(), strict=True):
                rows = [_spelled(x) for x in text.splitlines()]
                w = [y for x in rows for y in x]
                found_leads = [leader(x) for x in (w, *rows) if len(x) >= LEAST_WORDS and len(set(x)) <= len(x) * (1 - LEAD) + 1]
                p = np.concatenate([_phrases(w, known), *(_frames(w, x, known) for x in {x for x, share in found_leads if share >= LEAD})])
                p = p[table[p & (len(table) - 1)]]
                if len(p):
                    found.append(np.stack([p, np.full(len(p), host)], axis=1))
            u = np.unique(np.concatenate(found), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(u[:, 0]), pa.array(u[:, 1])], names=["phrase", "host"])

    return _hosted(documents).select("host", "text").mapInArrow(run, "phrase bigint, host bigint").distinct()


def spam_scores(documents: DataFrame) -> DataFrame:
    """(doc_id, n_words, list_words, repeated_words, replicated_words, stuffed_words): evidence of every page.

    Repetition and phrases on several hosts are counted each by itself; stuffed are the words of windows with either.
    Null ids and texts are left out; a repeated row is scored again; an empty table gives no rows.
    """
    return _scores(documents).drop("lines")


def _scores(documents: DataFrame) -> DataFrame:
    page = written(pages(documents), "pages")
    places = page.select(F.explode("windows.phrases").alias("p")).select(F.explode("p").alias("p")).select(F.col("p").bitwiseAND(F.lit((1 << TABLE_BITS) - 1)).cast("int").alias("place")).distinct()
    wanted = np.zeros(1 << TABLE_BITS, bool)
    wanted[places.toArrow().column("place").to_numpy()] = True
    replicated = phrase_hosts(documents, wanted).groupBy("phrase").agg(F.count(F.lit(1)).alias("hosts")).filter(F.col("hosts") >= HOSTS).select("phrase")
    window = page.filter(F.size("windows") > 0).select("doc_id", F.posexplode("windows").alias("w", "x"))
    hits = window.select("doc_id", "w", F.explode("x.phrases").alias("phrase")).join(replicated, "phrase", "left_semi").groupBy("doc_id", "w").agg(F.count(F.lit(1)).alias("hits"))
    judged = window.select("doc_id", "w", "x.n", "x.repeats", "x.least").join(hits, ["doc_id", "w"], "left")
    known = F.coalesce(F.col("hits") >= F.col("least"), F.lit(False))
    words_if = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("bigint")
    stuffed = judged.groupBy("doc_id").agg(words_if(F.col("repeats")).alias("repeated_words"), words_if(known).alias("replicated_words"), words_if(F.col("repeats") | known).alias("stuffed_words"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("repeated_words", "replicated_words", "stuffed_words")]
    return page.select("doc_id", "lines", "n", "listed").join(stuffed, "doc_id", "left").select("doc_id", "lines", F.col("n").alias("n_words"), F.col("listed").alias("list_words"), *zero)


def spam_pages(documents: DataFrame) -> DataFrame:
    """(doc_id) of pages of which more than half of the words are list or keyword evidence."""
    s = _scores(documents)
    return s.filter(((F.col("n_words") >= LEAST_WORDS) | (F.col("lines") > 1)) & (2 * (F.col("list_words") + F.col("stuffed_words")) > F.col("n_words"))).select("doc_id").distinct()


__all__ = ["line_kind", "page_evidence", "page_sentences", "pages", "sentence_words", "spam_pages", "spam_scores"]
