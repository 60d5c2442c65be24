"""Similar texts across two sides by bit fingerprints: permuted blocks of a similarity code.

A text's code has SEGMENTS segments of 32 bits: segment k is the least hash of its words
under the k-th hash function. Two texts agree in a segment with a probability equal to the
overlap of their word sets, ``common / (n + m - common)``, whichever words are edited; at a
word agreement of 70 % that is 7/13 or more. (Codes of signs of random directions would differ
there in a quarter of their bits, so their blocks would have to be so short, or so many, that
their number grows with the data.) A block is a leading segment with two others; ANCHORS
segments lead, each in PARTNERS blocks. Their number is fixed: it follows from the threshold
and the wanted recall alone.

The blocks travel and meet as keys of the packed join in ``overlap``: the leading segment
says where to, so a text is sent ANCHORS times at most, and PARTNERS times as often only for
leading segments that very many texts have. Texts of different sides that share a block are
kept if their bit fingerprints (odd sketches) lie within the Hamming radius of the
threshold, which loses nothing, and are verified on the words by the caller.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from .overlap import KEYS_PER_PARTITION, RARITY_BITS, _spread, match_keys, packed_keys, rarity, split_route

#: Leading segments, blocks of each, and segments from which their other two are taken.
ANCHORS, PARTNERS, OTHERS = 12, 6, 36
SEGMENTS = ANCHORS + OTHERS
#: Distinct words that nearly every text of some use has at least; for the expected size of a leading segment.
FEW_WORDS = 10

_ODD = np.random.Generator(np.random.PCG64(11)).integers(0, 1 << 62, SEGMENTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def partners() -> np.ndarray:
    """(ANCHORS, PARTNERS, 2): the other segments of each block, from fixed permutations."""
    rng = np.random.Generator(np.random.PCG64(23))
    return np.stack([rng.permutation(OTHERS)[: 2 * PARTNERS].reshape(PARTNERS, 2) + ANCHORS for _ in range(ANCHORS)])


def codes(tok: np.ndarray, n: np.ndarray) -> np.ndarray:
    """(SEGMENTS, texts): the segments of the codes of texts with ``n`` tokens each (one at least)."""
    start, x = np.cumsum(n) - n, _spread(tok.astype(np.uint64) + np.uint64(3))
    return np.stack([np.minimum.reduceat((x * odd) >> np.uint64(32), start) for odd in _ODD]) if len(n) else np.zeros((SEGMENTS, 0), np.uint64)


def code_keys(tok: np.ndarray, n: np.ndarray, tab: np.ndarray, count: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, route) of all blocks of a batch of texts; the route is that of the leading segment."""
    code = codes(tok, n)
    # how many texts may have a token (its count) and have it as the least of a leading segment
    often = count[tok >> np.uint32(32 - RARITY_BITS)].astype(np.float64)
    start, x = np.cumsum(n) - n, _spread(tok.astype(np.uint64) + np.uint64(3))
    rows, keys, routes = [], [], []
    for a, own in enumerate(partners()):
        h = (x * _ODD[a]) >> np.uint64(32)
        least = h == np.repeat(code[a], n)
        df = np.maximum.reduceat(np.where(least, often, 0.0), start) if len(n) else often[:0]
        texts = (df * (1 - code[a] / 2.0**32) ** (FEW_WORDS - 1)).astype(np.uint64)
        lead = _spread(code[a] + (np.uint64(a + 1) << np.uint64(33)) + (tab.astype(np.uint64) << np.uint64(48)))
        for i, j in own.tolist():
            key = _spread(_spread(lead + code[i]) + (code[j] << np.uint64(1)) + np.uint64(i))
            rows.append(np.arange(len(n)))
            keys.append(key)
            routes.append(split_route(lead, key, texts))
    return np.concatenate(rows), np.concatenate(keys), np.concatenate(routes)


def code_pairs(tokens: DataFrame, threshold: Fraction) -> DataFrame:
    """(tab, ca, cb): classes of written ``tokens`` of different sides (0 and 1) that share a block within the radius; a pair comes once."""
    partitions = max(2 * tokens.sparkSession.sparkContext.defaultParallelism, -(-tokens.count() * ANCHORS * PARTNERS // KEYS_PER_PARTITION))
    return match_keys(packed_keys(tokens, rarity(tokens), partitions, threshold, code_keys), partitions, threshold, True)


__all__ = ["ANCHORS", "PARTNERS", "SEGMENTS", "code_keys", "code_pairs", "codes", "partners"]
