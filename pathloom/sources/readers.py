"""Readers: question files of three formats, strict JSON lines, file fingerprints, dataset mappings."""

from __future__ import annotations

import ast
import fnmatch
import hashlib
import json
import operator
import re
from collections.abc import Iterator, Sequence
from fractions import Fraction

import pandas as pd
import pyarrow as pa
from pyarrow.fs import FileSelector, FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUESTION_SCHEMA = "query string, gt_ans string, query_metadata struct<level:int>, query_id string, query4test boolean"


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(path, length) of the files below ``path`` that match a glob; contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "length")


def missing_shards(names: DataFrame) -> DataFrame:
    """(shards, present, expected) of a snapshot of train-N-of-M files that is not whole: other files among them, several M, gaps."""
    n = F.regexp_extract("path", "/train-(\\d+)-of-(\\d+)\\.parquet$", 1)
    m = F.regexp_extract("path", "/train-(\\d+)-of-(\\d+)\\.parquet$", 2)
    per = names.select(F.when(n != "", n.cast("int")).alias("n"), F.when(m != "", m.cast("int")).alias("m")).agg(
        F.count(F.lit(1)).alias("files"), F.count("n").alias("shards"), F.count_distinct("n").alias("present"), F.min("m").alias("lo"), F.max("m").alias("expected"), F.max("n").alias("last")
    )
    return per.filter("shards > 0 and (files <> shards or lo <> expected or present <> expected or shards <> present or last <> expected - 1)").select("shards", "present", "expected")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Raw questions of a folder or file: Parquet if there is any, else JSON lines; a ``.json`` file holds one array.

    Only the five used columns are read. Incomplete shard snapshots are refused.
    """
    if path.endswith(".json"):
        return spark.read.schema(QUESTION_SCHEMA).option("multiLine", "true").option("mode", "FAILFAST").json(path)
    if path.endswith(".parquet"):
        return _question_columns(spark.read.parquet(path))
    if path.endswith(".jsonl"):
        return strict_questions(spark.read.text(path))
    files = list_files(spark, path, "*.parquet")
    if not files.isEmpty():
        if not missing_shards(files).isEmpty():
            raise ValueError(f"incomplete shard snapshot at {path}")
        return _question_columns(spark.read.option("recursiveFileLookup", "true").parquet(path))
    if list_files(spark, path, "*.jsonl").isEmpty():
        raise ValueError(f"no Parquet or JSON lines files at {path}")
    return strict_questions(spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path))


def _question_columns(df: DataFrame) -> DataFrame:
    have = {"query", "gt_ans", "query_metadata", "query_id", "query4test"} & set(df.columns)
    return df.select(*sorted(have))


def _no_twins(pairs):
    out = dict(pairs)
    if len(out) != len(pairs):
        raise ValueError("duplicate key")
    return out


def _no_constant(name):
    raise ValueError(f"non-finite number {name}")


def strict_error(line: str | None) -> str | None:
    """Why a line is no strict JSON object (blank, damaged, duplicate key, NaN or Infinity, no object), or None."""
    if line is None or not line.strip():
        return "blank"
    try:
        value = json.loads(line, object_pairs_hook=_no_twins, parse_constant=_no_constant)
    except RecursionError:
        return "damaged"
    except ValueError as e:
        return "duplicate key" if "duplicate" in str(e) else "non-finite" if "non-finite" in str(e) else "damaged"
    return None if isinstance(value, dict) else "no object"


def checked_lines(df: DataFrame, line: str, keep: list[str]) -> DataFrame:
    """``keep`` columns, the line and its ``error`` (null for a strict JSON object)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = [strict_error(x) for x in batch.column(line).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(errors, pa.string())], names=[*batch.schema.names, "error"])

    src = df.select(*keep, line)
    return src.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema) + ", error string")


def strict_questions(lines: DataFrame) -> DataFrame:
    """Questions of JSON lines ``lines``(value); any line that is no strict JSON object fails the read."""
    ok = checked_lines(lines, "value", [])
    value = F.when(F.col("error").isNull(), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("invalid JSON line: "), F.col("error"))))
    return ok.select(F.from_json(value, QUESTION_SCHEMA).alias("q")).select("q.*")


#: Bytes read at once from a file that is fingerprinted, and the head that tells a pointer file (fixed value).
BLOCK, POINTER_HEAD = 1 << 20, b"version https://git-lfs.github.com/spec/v1"


def _fingerprint(folder: str, name: str) -> tuple[str, bool]:
    """(SHA-256, whether it is a pointer file instead of its content) of a file, read in blocks."""
    fs, root = FileSystem.from_uri(folder)
    digest, head = hashlib.sha256(), b""
    with fs.open_input_stream(f"{root}/{name}") as f:
        while block := f.read(BLOCK):
            head = head or block[: len(POINTER_HEAD)]
            digest.update(block)
    return digest.hexdigest(), head == POINTER_HEAD


def file_inventory(spark: SparkSession, path: str, pattern: str = "*", hashed: str = ".*") -> DataFrame:
    """(file, bytes, sha256, is_pointer): fingerprints of all files of a folder whose names match a glob, empty ones among them.

    Files are read in blocks, one file per row and task, so their size doesn't matter. Those whose
    name doesn't match the regex ``hashed`` (weights, for a quick fingerprint) go by size only.
    Only names and sizes are listed on the driver.
    """
    fs, root = FileSystem.from_uri(path)
    found = [(x.path[len(root) :].lstrip("/"), x.size) for x in fs.get_file_info(FileSelector(root, recursive=True)) if x.is_file and fnmatch.fnmatch(x.base_name, pattern)]
    files = spark.createDataFrame(found, "path string, length bigint").select("*", F.regexp_extract("path", "([^/]+)$", 1).alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, file, wanted, size in zip(*(batch.column(c).to_pylist() for c in ("path", "file", "wanted", "length")), strict=True):
                sha, pointer = _fingerprint(path, name) if wanted else (None, None)
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([size], pa.int64()), pa.array([sha], pa.string()), pa.array([pointer], pa.bool_())], names=["file", "bytes", "sha256", "is_pointer"])

    wanted = files.withColumn("wanted", F.col("file").rlike(f"^(?:{hashed})$")).repartition(max(1, spark.sparkContext.defaultParallelism), "path")
    return wanted.mapInArrow(run, "file string, bytes bigint, sha256 string, is_pointer boolean")


def snapshot_errors(inventory: DataFrame, shards: Sequence[str] = ()) -> DataFrame:
    """(file, error) that forbid the use of a model snapshot: pointer files, empty files, and names in ``shards`` that aren't there."""
    bad = F.when(F.col("is_pointer"), F.lit("pointer")).when(F.col("bytes") == 0, F.lit("empty"))
    out = inventory.select("file", bad.alias("error")).filter("error is not null")
    if shards:
        wanted = inventory.sparkSession.createDataFrame([(x,) for x in shards], "file string")
        out = out.union(wanted.join(inventory.select("file"), "file", "left_anti").select("file", F.lit("missing")))
    return out


def unified(parts: dict[str, tuple[DataFrame, dict[str, Column]]], columns: list[str]) -> DataFrame:
    """Several sources under one schema: each maps its own expressions to ``columns``; missing ones are null."""
    out = None
    for name, (df, mapping) in parts.items():
        one = df.select(F.lit(name).alias("dataset"), *[mapping[c].alias(c) for c in columns if c in mapping])
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


_SPEC = re.compile(r"^\s*(\w+)\s*=\s*(.+?)\s*$")


def parse_dataset(spec: str) -> tuple[str, dict]:
    """``name;level=[1,2];domain=algebra;ref_ans=int;sample=100`` -> (name, filters). Values are literals, never evaluated."""
    name, *rest = [x for x in spec.split(";") if x.strip()]
    filters = {}
    for part in rest:
        m = _SPEC.match(part)
        if not m:
            raise ValueError(f"not a filter: {part!r}")
        try:
            filters[m[1]] = ast.literal_eval(m[2])
        except (ValueError, SyntaxError):
            filters[m[1]] = m[2]
    return name.strip(), filters


def is_integer_answer(answer: Column) -> Column:
    """The answer is a number without fraction, also one written as arithmetic such as 1/2 + 1/2. Nothing is executed."""
    n = answer.try_cast("double")
    plain = F.coalesce(n % 1 == 0, F.lit(False))
    sums = n.isNull() & F.coalesce(answer.rlike(r"^[0-9eE.+\-*/() \t_]{3,200}$"), F.lit(False))
    return plain | F.when(sums, _arithmetic_integer(F.when(sums, answer))).otherwise(F.lit(False))


_OPERATIONS = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.FloorDiv: operator.floordiv, ast.Mod: operator.mod}


def arithmetic(text: str) -> Fraction | None:
    """The exact value of numbers joined by + - * / // % ** and brackets, or nothing; powers are bounded."""

    def value(node: ast.AST) -> Fraction:
        if isinstance(node, ast.Constant) and isinstance(node.value, (int, float)) and not isinstance(node.value, bool):
            return Fraction(str(node.value))
        if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.UAdd, ast.USub)):
            return value(node.operand) * (-1 if isinstance(node.op, ast.USub) else 1)
        if isinstance(node, ast.BinOp):
            a, b = value(node.left), value(node.right)
            if isinstance(node.op, ast.Pow) and b.denominator == 1 and abs(b) <= 64:
                return a ** int(b)
            if type(node.op) in _OPERATIONS:
                return Fraction(_OPERATIONS[type(node.op)](a, b))
        raise ValueError("no arithmetic")

    try:
        return value(ast.parse(text.strip(), mode="eval").body)
    except (ValueError, SyntaxError, ZeroDivisionError, RecursionError, OverflowError, MemoryError):
        return None


@F.pandas_udf(T.BooleanType())
def _arithmetic_integer(text: pd.Series) -> pd.Series:
    values = [None if t is None else arithmetic(t) for t in text]
    return pd.Series([v is not None and v.denominator == 1 for v in values])


def filtered(df: DataFrame, filters: dict, key: str, seed: int = 42) -> DataFrame:
    """``df`` under the filters of a dataset spec; ``sample`` is a count (the first by content hash) or a fraction."""
    for name, value in filters.items():
        if name == "sample":
            continue
        if name == "ref_ans" and value == "int":
            df = df.filter(is_integer_answer(F.col("ref_ans")))
        elif isinstance(value, (list, tuple, set)):
            df = df.filter(F.col(name).isin(*value))
        else:
            df = df.filter(F.col(name) == F.lit(value))
    if "sample" in filters:
        h = F.sha2(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")), 256)
        if isinstance(filters["sample"], float):
            df = df.filter(F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") < int(filters["sample"] * 16**13))
        else:
            df = df.orderBy(h, key).limit(int(filters["sample"]))
    return df
