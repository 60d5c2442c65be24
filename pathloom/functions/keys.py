"""Question keys and content digests."""

from __future__ import annotations

import hashlib
import json
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = "[ \\t\\n\\r\\f\\x0B]+"


def question_key_of(text: str) -> str:
    """Compatibility-normalized text with single blanks."""
    return " ".join(unicodedata.normalize("NFKC", text).split())


def canonical_json(value) -> str:
    """JSON with sorted keys, ASCII escapes and no blanks; numbers must be finite."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=True, allow_nan=False)


def digest_of(value) -> str:
    """SHA-256 of the canonical JSON of ``value``."""
    return hashlib.sha256(canonical_json(value).encode("ascii")).hexdigest()


@F.pandas_udf(T.StringType())
def _json_digest(text: pd.Series) -> pd.Series:
    return pd.Series([None if t is None else digest_of(json.loads(t)) for t in text], dtype=object)


def digest_column(columns: list[str]) -> Column:
    """SHA-256 of the canonical JSON of a row's ``columns``; nulls are kept as null."""
    return _json_digest(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}))


@F.pandas_udf(T.StructType([T.StructField("key", T.StringType()), T.StructField("sample_id", T.StringType())]))
def _question_identity(text: pd.Series) -> pd.DataFrame:
    keys = [None if t is None else question_key_of(t) for t in text]
    return pd.DataFrame({"key": keys, "sample_id": [None if k is None else digest_of(k) for k in keys]})


def question_identity(text: Column) -> Column:
    """struct<key, sample_id>: the duplicate key of a question and its content id."""
    return _question_identity(text)


def plain_key(text: Column) -> Column:
    """The duplicate key that folds blanks only; stays in the JVM."""
    return F.trim(F.regexp_replace(text, BLANKS, " "))


def has_text(text: Column) -> Column:
    """Not null and not blank, for any Unicode blank."""
    return F.coalesce(text.rlike("(?U)\\S"), F.lit(False))
