"""Exact self-join of texts on shared words, for collections too large for all pairs.

Two texts match when the number of words in common (with multiplicity) is at least
``threshold`` times the word count of the longer one. The join is exact and consists of

1. ``tokenize``     each text becomes a set of 32-bit tokens; the k-th occurrence of a
                    word is its own token, so multiset overlap is set overlap.
2. ``rarity``       a histogram of token counts over a fixed number of hash buckets. It
                    covers all rows and its size never grows, so it can be broadcast.
                    Any total order of tokens is correct; a rare-first order is fast.
3. ``packed_keys``  rare-first prefixes. Two matching texts share at least ``g + 1``
                    tokens of their prefixes of length ``n - need + g + 1``, hence two of
                    them in one of ``g`` hash segments: every pair of prefix tokens in a
                    segment is a join key (an n-gram of the prefix). Short texts use
                    single tokens. Keys travel in packed blocks, one per task and
                    partition; the partition follows from the rarer token of a key, so a
                    text is sent once for all keys with that token (a frequent token is
                    split by the other one). Each text adds a bit fingerprint (an odd
                    sketch: parities of token hashes), whose Hamming distance never
                    exceeds the number of tokens that two texts don't share.
4. ``match_keys``   within equal keys, the length filter and the Hamming radius that
                    follows from the threshold drop nearly all other pairs. Long runs of
                    equal keys are cut into blocks; each pair of blocks is a task's row,
                    made only after the blocks have been spread.
5. ``verify``       each remaining pair is counted exactly, once.

Copies (the same word sequence) are one class throughout: a hot text costs one entry per
map task, not one per row. Positional filtering is contained in the key scheme (both
tokens of a key lie in both prefixes), suffix filtering in the Hamming radius.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, written
from .text import words

#: Log2 of the buckets of the rarity histogram: 1 MB, whatever the data.
RARITY_BITS = 18
#: 64-bit words of the bit fingerprint.
SKETCH_WORDS = 3
#: (least words of the longer text, segments): texts below the second bound use single tokens.
#: Each bound needs threshold * bound >= segments + 1.
SCHEMES = ((1, 0), (15, 10), (150, 60), (600, 240), (2400, 960), (9600, 3840), (38400, 15360), (153600, 61440))
#: Keys of one partition, which bounds a task's memory.
KEYS_PER_PARTITION = 4_000_000
#: Texts with one leading token beyond which its keys go to several partitions.
ROUTE_ROWS = 400_000
#: Tokens whose keys are made at once.
SLICE_TOKENS = 500_000
#: Classes with one key beyond which the run is cut into blocks of this many.
RUN_BLOCK = 16_384
#: Classes with one key from which the run is compared as one dense block.
DENSE = 16

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
TOKEN_SCHEMA = "tab string, id bigint, side int, c1 bigint, c2 bigint, b1 bigint, b2 bigint, n int, tok binary"
_ENTRY = np.dtype([("c1", "<u8"), ("sketch", "<u8", (SKETCH_WORDS,)), ("n", "<u4"), ("side", "u1"), ("tab", "u1")])
_KEY = np.dtype([("key", "<u4"), ("at", "<u2")])


def need(m, threshold: Fraction):
    """Words in common that the longer length ``m`` demands (rounded up)."""
    return -((-m * threshold.numerator) // threshold.denominator)


def _spread(x: np.ndarray) -> np.ndarray:
    x = x * _GOLD
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hash128(text: str, seed: int = 0) -> tuple[int, int]:
    """128 bits of ``text`` as two signed 64-bit integers."""
    h = xxhash.xxh3_128_intdigest(text.encode("utf-8", "surrogatepass"), seed)
    return _signed(h >> 64), _signed(h & ((1 << 64) - 1))


def occurrence_tokens(hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """32-bit tokens, row by row, of concatenated word hashes; repeated words get distinct tokens."""
    row = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
    v = np.sort((row << np.uint64(32)) | hashes.astype(np.uint64))
    at = np.arange(len(v))
    start = np.maximum.accumulate(np.where(np.r_[True, v[1:] != v[:-1]], at, 0)) if len(v) else at
    nth = (at - start).astype(np.uint64)
    word = v & np.uint64(0xFFFFFFFF)
    return np.where(nth > 0, _spread(word + nth * _GOLD), word).astype(np.uint32)


def tokenize(df: DataFrame) -> DataFrame:
    """``df``(tab, id, side, text) -> one row of TOKEN_SCHEMA per row with at least one word.

    c1, c2 identify the word sequence (the class of copies), b1, b2 the bare text.
    Null, empty and blank texts have no words and are left out, as are rows without table or
    id. A null side counts as 0. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for batch in batches:
            keep, hashes, lengths, ids = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                w = words(text) if text else ()
                if not w:
                    continue
                for x in w:
                    h = known.get(x)
                    if h is None:
                        if len(known) > 300_000:
                            known.clear()
                        h = known[x] = xxhash.xxh32_intdigest(x.encode("utf-8", "surrogatepass"))
                    hashes.append(h)
                keep.append(i)
                lengths.append(len(w))
                ids.append(hash128(" ".join(w), 1) + hash128("".join(w)))
            if not keep:
                continue
            n = np.array(lengths, dtype=np.int64)
            tok = occurrence_tokens(np.array(hashes, dtype=np.uint32), n)
            end = np.cumsum(n) * 4
            rest = batch.take(pa.array(keep))
            cols = np.array(ids, dtype=np.int64)
            yield pa.RecordBatch.from_arrays(
                [rest.column("tab"), rest.column("id"), rest.column("side"), *(pa.array(cols[:, k]) for k in range(4)), pa.array(n.astype(np.int32)),
                 pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(np.r_[0, end].astype(np.int32)), pa.py_buffer(tok)])],
                names=["tab", "id", "side", "c1", "c2", "b1", "b2", "n", "tok"],
            )

    rows = df.filter("tab is not null and id is not null")
    side = F.coalesce(F.col("side").cast("int"), F.lit(0)).alias("side")
    return rows.select("tab", F.col("id").cast("bigint"), side, F.col("text").cast("string")).mapInArrow(run, TOKEN_SCHEMA)


def _flat(column: pa.Array) -> np.ndarray:
    """All tokens of a binary column, row after row."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32)


def rarity(tokens: DataFrame) -> np.ndarray:
    """Token counts by hash bucket over all rows: at most 2**RARITY_BITS numbers."""
    shift = np.uint32(32 - RARITY_BITS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(1 << RARITY_BITS, dtype=np.int64)
        for batch in batches:
            count += np.bincount(_flat(batch.column(0)) >> shift, minlength=len(count))
        at = np.nonzero(count)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(count[at])], names=["bucket", "n"])

    out = np.zeros(1 << RARITY_BITS, dtype=np.int64)
    got = tokens.select("tok").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return np.minimum(out, 2**31 - 1).astype(np.int32)


def _sketches(tok: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Odd sketches: bit = parity of the number of tokens with that hash."""
    bits = 64 * SKETCH_WORDS
    bit = (_spread(tok.astype(np.uint64) + np.uint64(7)) % np.uint64(bits)).astype(np.int64)
    odd = (np.bincount(row * bits + bit, minlength=rows * bits) & 1).astype(np.uint8).reshape(rows, bits)
    return np.packbits(odd, axis=1, bitorder="little").view("<u8").reshape(rows, SKETCH_WORDS)


#: Makes the join keys of a batch: (tokens, lengths, tables, token counts, threshold) -> (row, 64-bit key, 64-bit route) of each key.
KeyMaker = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Fraction], tuple[np.ndarray, np.ndarray, np.ndarray]]


def batch_keys(tok: np.ndarray, n: np.ndarray, tab: np.ndarray, count: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, route) of all join keys of a batch of texts, by every scheme a partner may be in. Keys with one rarer token have one route."""
    row = np.repeat(np.arange(len(n)), n)
    df = count[tok >> np.uint32(32 - RARITY_BITS)].astype(np.uint64)
    order = np.lexsort(((df << np.uint64(32)) | tok, row))
    tok, df = tok[order], df[order]
    pos = np.arange(len(tok)) - np.repeat(np.cumsum(n) - n, n)
    rows, keys, routes = [], [], []
    for k, (low, groups) in enumerate(SCHEMES):
        high = SCHEMES[k + 1][0] if k + 1 < len(SCHEMES) else 1 << 60
        use = (n < high) & (need(low, threshold) <= n) & (n * threshold.denominator // threshold.numerator >= low)
        if not use.any():
            continue
        length = np.where(use, n - need(np.maximum(n, low), threshold) + groups + 1, 0)
        pick = pos < length[row]
        t, r, often = tok[pick].astype(np.uint64), row[pick], df[pick]
        h = _spread(t + np.uint64(k << 40) + (tab[r].astype(np.uint64) << np.uint64(48)))
        if groups == 0:
            rows.append(r)
            keys.append(h)
            routes.append(h)
            continue
        seg = (_spread(t + np.uint64(k + 11)) % np.uint64(groups)).astype(np.int64)
        at = r * groups + seg
        order = np.argsort(at, kind="stable")  # rare tokens stay first
        at, h, r, often = at[order], h[order], r[order], often[order]
        step = 1
        a = np.arange(len(at))
        while True:
            a = a[a + step < len(at)]
            a = a[at[a] == at[a + step]]
            if not len(a):
                break
            key = _spread(h[a] * np.uint64(3) + h[a + step])
            rows.append(r[a])
            keys.append(key)
            routes.append(split_route(h[a], key, often[a]))
            step += 1
    if not rows:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(routes)


def split_route(lead: np.ndarray, key: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """One route for all keys with one leading part, several where more than ROUTE_ROWS ``texts`` have that part."""
    return _spread(lead + (key % (texts // np.uint64(ROUTE_ROWS) + np.uint64(1))) * _GOLD)


def key_count(tokens: DataFrame, threshold: Fraction) -> int:
    """Keys of all ``tokens`` by ``batch_keys``, estimated from the lengths of all texts."""
    n, total = F.col("n"), F.lit(0.0)
    for k, (low, groups) in enumerate(SCHEMES):
        high = SCHEMES[k + 1][0] if k + 1 < len(SCHEMES) else 1 << 40
        longer = F.greatest(n, F.lit(low)) * (threshold.numerator / threshold.denominator)
        length = n - longer + groups + 1
        per = length if groups == 0 else length * (length - 1) / (2.0 * groups)
        total += F.when((n < high) & (n >= low * threshold.numerator / threshold.denominator), per).otherwise(0.0)
    return int(tokens.agg(F.sum(total)).first()[0] or 0)


def packed_keys(tokens: DataFrame, count: np.ndarray, partitions: int, threshold: Fraction, make: KeyMaker = batch_keys) -> DataFrame:
    """Packed blocks (p, entries, keys): the classes of one task that have keys in partition ``p``."""
    shared = tokens.sparkSession.sparkContext.broadcast(count)

    def of_slice(c1: np.ndarray, side: np.ndarray, tab: np.ndarray, n: np.ndarray, tok: np.ndarray) -> list[tuple[int, bytes, bytes]]:
        entry = np.zeros(len(n), _ENTRY)
        entry["c1"], entry["n"], entry["side"], entry["tab"] = c1.view(np.uint64), n, side, tab
        entry["sketch"] = _sketches(tok, np.repeat(np.arange(len(n)), n), len(n))
        row, key, route = make(tok, n, tab, shared.value, threshold)
        part = (route % np.uint64(partitions)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        row, key, part = row[order], key[order], part[order]
        start = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0] if len(part) else []
        out = []
        for a, b in zip(start, [*start[1:], len(part)], strict=True):
            own, at = np.unique(row[a:b], return_inverse=True)
            keys = np.empty(b - a, _KEY)
            keys["key"], keys["at"] = key[a:b] & np.uint64(0xFFFFFFFF), at
            out.append((int(part[a]), entry[own].tobytes(), keys.tobytes()))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            c1, side = batch.column("c1").to_numpy(), batch.column("side").to_numpy()
            tab = np.array([sum(x.encode()) & 255 for x in batch.column("tab").to_pylist()], dtype=np.uint8)
            new = []
            for i, x in enumerate(zip(c1.tolist(), side.tolist(), tab.tolist(), strict=True)):
                if x not in seen:
                    seen.add(x)
                    new.append(i)
            if len(seen) > 2_000_000:
                seen.clear()
            new = np.array(new, np.int64)
            size = np.cumsum(batch.column("n").to_numpy()[new].astype(np.int64))
            lo = 0
            while lo < len(new):
                hi = max(lo + 1, min(lo + 60_000, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + SLICE_TOKENS, side="right"))))
                own = new[lo:hi]
                n = batch.column("n").to_numpy()[own].astype(np.int64)
                out = of_slice(c1[own], side[own], tab[own], n, _flat(batch.column("tok").take(pa.array(own))))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary())], names=["p", "entries", "keys"])
                lo = hi

    return tokens.select("tab", "side", "c1", "n", "tok").mapInArrow(run, "p int, entries binary, keys binary")


def close_pairs(entry: np.ndarray, i: np.ndarray, j: np.ndarray, threshold: Fraction, cross: bool) -> np.ndarray:
    """Which pairs pass side, table, length and Hamming filters."""
    a, b = entry[i], entry[j]
    n, m = a["n"].astype(np.int64), b["n"].astype(np.int64)
    longer, shorter = np.maximum(n, m), np.minimum(n, m)
    least = need(longer, threshold)
    far = np.bitwise_count(a["sketch"] ^ b["sketch"]).sum(axis=1, dtype=np.int64)
    ok = (far <= n + m - 2 * least) & (shorter >= least) & (a["c1"] != b["c1"]) & (a["tab"] == b["tab"])
    return ok & (a["side"] != b["side"]) if cross else ok


def radius(n: np.ndarray, threshold: Fraction) -> np.ndarray:
    """An upper bound of the Hamming distance of a text with ``n`` words to any match, as one byte."""
    return np.minimum(2 * n * (threshold.denominator - threshold.numerator) // threshold.denominator, 255).astype(np.uint8)


def dense_pairs(code: np.ndarray, within: np.ndarray, first: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j, j >= first, of one block whose fingerprints lie within the radius of i.

    ``code`` has one row per fingerprint word. Rows of the block are compared in portions of bounded size.
    """
    m = code.shape[1]
    rows = max(1, min((1 << 18) // max(m, 1), max(128, m // 8)))
    for lo in range(0, first or m, rows):
        hi = min(lo + rows, first or m)
        right = max(lo, first)
        d = np.bitwise_count(code[0, lo:hi, None] ^ code[0, right:])
        d += np.bitwise_count(code[1, lo:hi, None] ^ code[1, right:])
        i, j = np.nonzero(d <= within[lo:hi, None])
        if not len(i):
            continue
        far = d[i, j]
        i += lo
        j += right
        for word in code[2:]:
            far = far + np.bitwise_count(word[i] ^ word[j])
        keep = (far <= within[i]) & (i < j)
        yield i[keep], j[keep]


def _runs(start: np.ndarray, size: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All index pairs within runs of equal keys, in bounded portions."""
    gap = 1
    while len(start):
        keep = size > gap
        start, size = start[keep], size[keep]
        left = size - gap
        bounds = np.searchsorted(np.cumsum(left), np.arange(0, left.sum() + most, most)) if len(left) else []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            hi = hi if hi < len(left) - 1 else len(left)
            k = left[lo:hi]
            if k.sum():
                i = np.repeat(start[lo:hi], k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
                yield i, i + gap
            if hi == len(left):
                break
        gap += 1


_FOUND = "tab int, ca bigint, cb bigint, block binary, run bigint, at int, blocks int"


def _pairs(entry: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Distinct (tab, lower class, upper class)."""
    x, y = entry["c1"][i].view(np.int64), entry["c1"][j].view(np.int64)
    return np.unique(np.stack([entry["tab"][i].astype(np.int64), np.minimum(x, y), np.maximum(x, y)], axis=1), axis=0)


def match_keys(keys: DataFrame, partitions: int, threshold: Fraction, cross: bool) -> DataFrame:
    """(tab, ca, cb) of classes that share a key and pass the filters; a pair may come more than once."""

    names = ["tab", "ca", "cb", "block", "run", "at", "blocks"]

    def of_partition(p: int, blocks: list[tuple[bytes, bytes]]) -> Iterator[pa.RecordBatch]:
        entries = [np.frombuffer(e, _ENTRY) for e, _ in blocks]
        packed = [np.frombuffer(k, _KEY) for _, k in blocks]
        base = np.cumsum([0, *map(len, entries)])
        entry = np.concatenate(entries)
        at = np.concatenate([k["at"].astype(np.int64) + b for k, b in zip(packed, base, strict=False)])
        key = np.concatenate([k["key"] for k in packed])
        # one number per class and side, so that copies from several tasks count once
        same = np.lexsort((entry["side"], entry["tab"], entry["c1"]))
        s = entry[same]
        first = np.r_[True, (s["c1"][1:] != s["c1"][:-1]) | (s["side"][1:] != s["side"][:-1]) | (s["tab"][1:] != s["tab"][:-1])]
        number = np.empty(len(entry), np.int64)
        number[same] = np.cumsum(first) - 1
        entry = s[first]
        v = (key.astype(np.uint64) << np.uint64(32)) | number[at].astype(np.uint64)
        v.sort()
        v = v[np.r_[True, v[1:] != v[:-1]]]
        key, at = v >> np.uint64(32), (v & np.uint64(0xFFFFFFFF)).astype(np.int64)
        start = np.nonzero(np.r_[True, key[1:] != key[:-1]])[0]
        size = np.diff(np.r_[start, len(key)])
        big, small = size > RUN_BLOCK, size < DENSE
        code, within = np.ascontiguousarray(entry["sketch"].T), radius(entry["n"].astype(np.int64), threshold)
        other = entry["side"] == 1
        found, held, near_i, near_j = [np.zeros((0, 3), np.int64)], 0, [], []

        def settle() -> None:
            nonlocal held
            pair = np.concatenate(near_i) * len(entry) + np.concatenate(near_j)
            pair.sort()
            i, j = np.divmod(pair[np.r_[True, pair[1:] != pair[:-1]]] if len(pair) else pair, len(entry))
            ok = close_pairs(entry, i, j, threshold, cross)
            found.append(_pairs(entry, i[ok], j[ok]))
            near_i.clear()
            near_j.clear()
            held = 0
            if sum(map(len, found)) > 1_000_000:
                found[:] = [np.unique(np.concatenate(found), axis=0)]

        for i, j in _runs(start[small], size[small]):
            i, j = at[i], at[j]
            if cross:
                apart = other[i] != other[j]
                i, j = i[apart], j[apart]
            far = np.bitwise_count(code[0][i] ^ code[0][j])
            for word in code[1:]:
                far = far + np.bitwise_count(word[i] ^ word[j])
            ok = far <= within[i]
            near_i.append(i[ok])
            near_j.append(j[ok])
            held += int(ok.sum())
            if held > 500_000:
                settle()
        for s0, m in zip(start[~big & ~small].tolist(), size[~big & ~small].tolist(), strict=True):
            run, first = at[s0 : s0 + m], 0
            if cross:  # one side first, so that only pairs across are compared
                run = run[np.argsort(other[run], kind="stable")]
                first = m - int(other[run].sum())
                if first in (0, m):
                    continue
            for i, j in dense_pairs(code[:, run], within[run], first):
                if len(i):
                    near_i.append(run[i])
                    near_j.append(run[j])
                    held += len(i)
            if held > 500_000:
                settle()
        if near_i:
            settle()
        u = np.unique(np.concatenate(found), axis=0)
        for lo in range(0, len(u), 100_000):
            x = u[lo : lo + 100_000]
            none = [pa.nulls(len(x), t) for t in (pa.binary(), pa.int64(), pa.int32(), pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].astype(np.int32)), pa.array(x[:, 1]), pa.array(x[:, 2]), *none], names=names)
        for s0, m in zip(start[big].tolist(), size[big].tolist(), strict=True):
            if cross and len(set(other[at[s0 : s0 + m]].tolist())) < 2:
                continue
            blocks = -(-m // RUN_BLOCK)
            for k in range(blocks):
                part = entry[at[s0 + k * RUN_BLOCK : min(s0 + (k + 1) * RUN_BLOCK, s0 + m)]].tobytes()
                values = (None, None, None, part, (p << 32) | int(key[s0]), k, blocks)
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(values, (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=names)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for p, e, k in zip(*(batch.column(c).to_pylist() for c in ("p", "entries", "keys")), strict=True):
                held.setdefault(p, []).append((e, k))
        for p in sorted(held):
            yield from of_partition(p, held.pop(p))

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[tuple[int, int, int], bytes] = {}
        for batch in batches:
            for run, lo, hi, block in zip(*(batch.column(c).to_pylist() for c in ("run", "lo", "hi", "block")), strict=True):
                parts = [np.frombuffer(block, _ENTRY)]
                if lo != hi:
                    first = waiting.pop((run, lo, hi), None)
                    if first is None:
                        waiting[run, lo, hi] = block
                        continue
                    parts.append(np.frombuffer(first, _ENTRY))
                both = np.concatenate(parts)
                within = radius(both["n"].astype(np.int64), threshold)
                u = [np.zeros((0, 3), np.int64)]
                for x, y in dense_pairs(np.ascontiguousarray(both["sketch"].T), within, len(parts[0]) if len(parts) > 1 else 0):
                    ok = close_pairs(both, x, y, threshold, cross)
                    u.append(_pairs(both, x[ok], y[ok]))
                u = np.unique(np.concatenate(u), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(u[:, 0].astype(np.int32)), pa.array(u[:, 1]), pa.array(u[:, 2])], names=["tab", "ca", "cb"])

    found = written(keys.repartitionById(partitions, F.col("p")).mapInArrow(reduce, _FOUND), "found")
    near, long = found.filter("block is null").select("tab", "ca", "cb"), found.filter("block is not null")
    if long.isEmpty():
        return near.distinct()
    # the blocks of long runs are spread before each is repeated for its tiles
    tiles = long.select("run", "at", "blocks", "block").repartition(F.col("run"), F.col("at")).select("run", "block", "at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    tiles = tiles.select("run", F.least("at", "other").alias("lo"), F.greatest("at", "other").alias("hi"), "block").repartition(F.col("run"), F.col("lo"), F.col("hi"))
    return near.union(tiles.mapInArrow(expand, "tab int, ca bigint, cb bigint")).distinct()


def verify(pairs: DataFrame, tokens: DataFrame, threshold: Fraction) -> DataFrame:
    """(tab, a1, a2, b1, b2, ...) of class pairs whose words agree to the threshold, counted exactly.

    Out come the class ids (a1, a2) and (b1, b2), the bare ids (x1, x2) and (y1, y2) and ``common`` and ``longer``.
    """
    used = pairs.select(F.col("ca").alias("c1")).union(pairs.select(F.col("cb").alias("c1"))).distinct()
    classes = written(
        tokens.select("c1", "c2", "b1", "b2", "n", "tok").join(used, "c1", "left_semi").groupBy("c1", "c2").agg(*(F.first(c).alias(c) for c in ("b1", "b2", "n", "tok"))),
        "classes",
    )
    side = lambda a, b, x, t: classes.select(F.col("c1").alias(a + "1"), F.col("c2").alias(a + "2"), F.col("b1").alias(x + "1"), F.col("b2").alias(x + "2"), F.col("n").alias(t + "n"), F.col("tok").alias(t))
    both = pairs.withColumnsRenamed({"ca": "a1", "cb": "d1"}).join(side("a", "a", "x", "t"), "a1").join(side("d", "d", "y", "u"), "d1")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = (batch.column(c).to_numpy().astype(np.int64) for c in ("tn", "un"))
            row = np.arange(len(n), dtype=np.uint64) << np.uint64(32)
            v = np.sort(np.concatenate([np.repeat(row, n) | _flat(batch.column("t")), np.repeat(row, m) | _flat(batch.column("u"))]))
            common = np.bincount((v[1:][v[1:] == v[:-1]] >> np.uint64(32)).astype(np.int64), minlength=len(n))
            longer = np.maximum(n, m)
            keep = pa.array(common >= need(longer, threshold))
            out = batch.select(["tab", "a1", "a2", "x1", "x2", "d1", "d2", "y1", "y2"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(common.astype(np.int32)), pa.array(longer.astype(np.int32))], names=[*out.schema.names, "common", "longer"]).filter(keep)

    schema = "tab int, a1 bigint, a2 bigint, x1 bigint, x2 bigint, d1 bigint, d2 bigint, y1 bigint, y2 bigint, common int, longer int"
    return both.select("tab", "a1", "a2", "x1", "x2", "tn", "t", "d1", "d2", "y1", "y2", "un", "u").mapInArrow(run, schema)


def similar_classes(tokens: DataFrame, threshold: Fraction, cross: bool = False) -> DataFrame:
    """The pairs of classes of written ``tokens`` that match; with ``cross`` only pairs whose rows have different sides."""
    count = rarity(tokens)
    partitions = max(2 * tokens.sparkSession.sparkContext.defaultParallelism, -(-key_count(tokens, threshold) // KEYS_PER_PARTITION))
    pairs = match_keys(packed_keys(tokens, count, partitions, threshold), partitions, threshold, cross)
    return verify(written(pairs, "pairs"), tokens, threshold)


def written_tokens(df: DataFrame) -> DataFrame:
    """``tokenize``, evenly spread over the cores and written once."""
    return written(tokenize(df), "tokens")


__all__ = ["hash128", "match_keys", "need", "occurrence_tokens", "packed_keys", "parallelism", "rarity", "similar_classes", "tokenize", "verify", "written_tokens"]
