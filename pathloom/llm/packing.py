"""Problem 6: documents in containers of one fixed token capacity.

Sizes are token counts under a public byte-pair vocabulary, whose path is a parameter.
Documents are spread over groups of bounded size by a hash of their id; each group is packed
on its own by Karmarkar-Karp multiway differencing, which merges the two partial partitions
with the largest imbalances so that the heaviest windows of one meet the lightest of the
other. The number of windows starts at the least possible and rises while any exceeds the
capacity. A longer document fills whole containers and only its rest is packed.
"""

from __future__ import annotations

import base64
import functools
import heapq
import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import parallelism, written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The published splitting pattern of that byte-pair vocabulary (fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of one group on average; bounds a task and the cost of differencing.
GROUP_ITEMS = 1024
#: Groups that one task packs on average at most.
GROUPS_PER_TASK = 64


@functools.lru_cache(maxsize=2)
def _encoding(name: str):
    import tiktoken

    with open(SparkFiles.get(name), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of the whole text of every row; null and empty texts have none.

    ``vocabulary`` is a path on the driver, from where the file is sent to every executor.
    """
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encode, split, known = _encoding(name).encode_ordinary, regex.compile(PATTERN).findall, {}
        for batch in batches:
            n = []
            for text in batch.column("text").to_pylist():
                total = 0
                for piece in split(text or ""):
                    k = known.get(piece)
                    if k is None:
                        if len(known) > 200_000:
                            known.clear()
                        k = known[piece] = len(encode(piece))
                    total += k
                n.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, "doc_id bigint, n_tokens bigint")


def differencing(sizes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp: (window of each item, sum of each window) of a near-equal k-way partition."""
    n = len(sizes)
    left, right = [], []  # inner nodes of the trees of items, numbered from n
    heap = []
    for i, s in enumerate(sizes.tolist()):
        sums, node = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], node[0] = s, i
        heap.append((-s, i, sums, node, 0))
    heapq.heapify(heap)
    made, serial = n, n
    while len(heap) > 1:
        _, _, a, x, base_a = heapq.heappop(heap)
        _, _, b, y, base_b = heapq.heappop(heap)
        b, y = b[::-1], y[::-1]
        s = a + b
        node = np.where(x < 0, y, x)
        both = np.nonzero((x >= 0) & (y >= 0))[0]
        if len(both):
            left.append(x[both])
            right.append(y[both])
            node[both] = np.arange(made, made + len(both))
            made += len(both)
        order = np.argsort(-s, kind="stable")
        s, node = s[order], node[order]
        low = int(s[-1])
        serial += 1
        heapq.heappush(heap, (-(int(s[0]) - low), serial, s - low, node, base_a + base_b + low))
    _, _, sums, node, base = heap[0]
    window = np.full(made, -1, np.int64)
    window[node[node >= 0]] = np.nonzero(node >= 0)[0]
    if left:
        for at, l, r in zip(range(made - 1, n - 1, -1), np.concatenate(left)[::-1], np.concatenate(right)[::-1], strict=True):
            window[l] = window[r] = window[at]
    return window[:n], sums + base


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Window of each item; every item is at most ``capacity``, no window exceeds it, few windows are used."""
    if not len(sizes):
        return np.zeros(0, np.int64)
    k = max(1, -(-int(sizes.sum()) // capacity))
    step, bad, good = 1, k - 1, None
    while good is None:
        window, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            good = (k, window)
        else:
            bad, k = k, min(k + step, len(sizes))
            step *= 2
    while good[0] - bad > 1:
        k = (good[0] + bad) // 2
        window, sums = differencing(sizes, k)
        if sums.max() <= capacity:
            good = (k, window)
        else:
            bad = k
    return good[1]


def containers(counts: DataFrame, capacity: int, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(doc_id, part, container, place, n_tokens, first_token): where each document's tokens go.

    A document within the capacity is one row (part 0). A longer one has a row per container;
    only its last part shares a container with others. ``place`` is the token offset inside the
    container, ``first_token`` the offset inside the document. Documents without tokens get a
    place of length 0, as has a null count. Repeated rows are placed each. Null ids are placed
    like others. Other columns are ignored.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    counts = written(counts.select(F.col("doc_id").cast("bigint"), F.coalesce(F.col("n_tokens").cast("bigint"), F.lit(0)).alias("n_tokens")), "sizes")
    groups = max(1, -(-counts.count() // group_items))
    spread = F.coalesce("doc_id", F.monotonically_increasing_id())  # null ids are spread as well
    rows = counts.withColumn("g", F.pmod(F.xxhash64(spread, F.lit(20)), F.lit(groups)))
    schema = "doc_id bigint, part int, container string, place bigint, n_tokens bigint, first_token bigint"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "n_tokens"], kind="stable").reset_index(drop=True)
        most = 4 * group_items  # a group is this large only if one id comes very often
        return pd.concat([placed(pdf[k : k + most].reset_index(drop=True), f"{pdf['g'].iloc[0]}" + f".{k // most}" * (k > 0)) for k in range(0, len(pdf), most)], ignore_index=True)

    def placed(pdf: pd.DataFrame, g: str) -> pd.DataFrame:
        n = pdf["n_tokens"].to_numpy(np.int64)
        full = np.where(n > capacity, n // capacity, 0)
        rest = n - full * capacity
        packed = (rest > 0) | (full == 0)
        at = np.nonzero(packed)[0]
        window = pack(rest[at], capacity)
        order = np.argsort(window, kind="stable")
        size, sorted_window = rest[at][order], window[order]
        start = np.cumsum(size) - size
        first = np.r_[True, sorted_window[1:] != sorted_window[:-1]]
        place = np.empty(len(at), np.int64)
        place[order] = start - np.repeat(start[first], np.diff(np.r_[np.nonzero(first)[0], len(size)]))
        whole = np.repeat(np.arange(len(n)), full)
        part = np.arange(len(whole)) - np.repeat(np.cumsum(full) - full, full)
        out = [
            pd.DataFrame({"doc_id": pdf["doc_id"].iloc[at], "part": full[at].astype(np.int32), "container": [f"{g}-{w}" for w in window], "place": place, "n_tokens": rest[at], "first_token": full[at] * capacity}),
            pd.DataFrame({"doc_id": pdf["doc_id"].iloc[whole], "part": part.astype(np.int32), "container": [f"{g}-full-{i}" for i in range(len(whole))], "place": 0, "n_tokens": capacity, "first_token": part * capacity}),
        ]
        return pd.concat(out, ignore_index=True)

    # the rows are few bytes and much work: a number of partitions of one's own isn't coalesced
    tasks = min(groups, max(parallelism(counts.sparkSession), -(-groups // GROUPS_PER_TASK)))
    return rows.repartition(tasks, "g").groupBy("g").applyInPandas(run, schema)


def fill_report(placed: DataFrame, capacity: int) -> DataFrame:
    """(capacity, containers, tokens, fill): how full the containers are."""
    per = placed.groupBy("container").agg(F.sum("n_tokens").alias("n"))
    return per.agg(F.lit(capacity).alias("capacity"), F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.round(F.sum("n") / (F.count(F.lit(1)) * capacity), 6).alias("fill"))
