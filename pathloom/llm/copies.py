"""Problem 5: copies hidden by formatting, collapsed by a canonical 128-bit hash."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import hot_joined, written
from .overlap import hash128
from .text import bare


def _constant(name: str):
    raise ValueError(f"{name} is no JSON")


def _canonical(x):
    """A JSON value in which strings are bare texts and equal numbers are written alike."""
    if isinstance(x, str):
        return ["s", bare(x)]
    if isinstance(x, dict):
        return {k: _canonical(v) for k, v in x.items()}
    if isinstance(x, list):
        return ["a", *map(_canonical, x)]
    if isinstance(x, float) and x.is_integer():
        return int(x)
    return x


def canonical_record(payload: str) -> str | None:
    """The canonical text of a JSON record whatever its field order, blanks and escapes; null if it is damaged."""
    try:
        return json.dumps(_canonical(json.loads(payload, parse_constant=_constant)), sort_keys=True, ensure_ascii=False)
    except (ValueError, RecursionError):
        return None


def canonical_hashes(df: DataFrame) -> DataFrame:
    """``df``(tab, id, text, is_json) -> (tab, id, h1, h2, chk) for rows that can have copies.

    h1, h2 are 128 bits of the canonical text; chk is another 64 bits from a different
    hash of it, with which collisions are told apart. Null, empty, blank, mark-only texts
    and damaged records are left out, as are rows without table or id. A null is_json means
    plain text. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, out = [], []
            for i, (text, is_json) in enumerate(zip(batch.column("text").to_pylist(), batch.column("is_json").to_pylist(), strict=True)):
                c = (canonical_record(text) if is_json else bare(text)) if text else None
                if c:
                    keep.append(i)
                    chk = xxhash.xxh64_intdigest(c.encode("utf-8", "surrogatepass"), 7)
                    out.append((*hash128(c), chk - (1 << 64) if chk >> 63 else chk))
            if keep:
                rest, cols = batch.take(pa.array(keep)), np.array(out, dtype=np.int64)
                yield pa.RecordBatch.from_arrays([rest.column("tab"), rest.column("id"), *(pa.array(cols[:, k]) for k in range(3))], names=["tab", "id", "h1", "h2", "chk"])

    rows = df.filter("tab is not null and id is not null")
    return rows.select("tab", F.col("id").cast("bigint"), F.col("text").cast("string"), "is_json").mapInArrow(run, "tab string, id bigint, h1 bigint, h2 bigint, chk bigint")


def records(raw_question: DataFrame, manifest: DataFrame, raw_line: DataFrame) -> DataFrame:
    """The three tables as (tab, id, text, is_json)."""
    part = lambda df, tab, i, text, is_json: df.select(F.lit(tab).alias("tab"), F.col(i).cast("bigint").alias("id"), F.col(text).alias("text"), F.lit(is_json).alias("is_json"))
    return part(raw_question, "raw_question", "raw_id", "query", False).union(part(manifest, "manifest", "global_index", "question", False)).union(part(raw_line, "raw_line", "line_id", "payload", True))


def collapsed(hashes: DataFrame, repeated: tuple[str, ...] | None = None) -> DataFrame:
    """(tab, keep_id, n_copies): one row per set of copies, single records included.

    Counts are combined before the shuffle, so a set that holds a third of all rows costs
    a few partial rows. Rows of one id count once: ``repeated`` names the tables in which an id
    may come in several rows (all, if not given); only their rows are made distinct first.
    """
    many = F.lit(True) if repeated is None else F.col("tab").isin(*repeated)
    rows = hashes.filter(many).distinct().union(hashes.filter(~many))
    return rows.groupBy("tab", "h1", "h2", "chk").agg(F.min("id").alias("keep_id"), F.count(F.lit(1)).alias("n_copies")).select("tab", "keep_id", "n_copies")


def copy_pairs(df: DataFrame) -> DataFrame:
    """(tab, keep_id, copy_id): every member of a set of copies but the one with the least id; a repeated row counts once."""
    rows = written(canonical_hashes(df), "hashes")
    key = ["tab", "h1", "h2", "chk"]
    sets = rows.groupBy(*key).agg(F.min("id").alias("keep_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")).filter("keep_id < last_id")
    sets = written(sets.select(*key, "keep_id", "n"), "sets")
    return hot_joined(rows, sets.drop("n"), key, counts=sets).filter("id <> keep_id").select("tab", "keep_id", F.col("id").alias("copy_id")).distinct()
