"""Writers: write-once partitioned tables, single CSV files, JSON lines, summaries, resume and quarantine."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def write_once(df: DataFrame, path: str, by: list[str]) -> bool:
    """Write ``df`` partitioned by ``by``, or check that the same rows are there already; True if written.

    Rows that differ from what is there are an error and change nothing. The commit protocol
    makes a broken-off write invisible.
    """
    spark = df.sparkSession
    if not _exists(spark, f"{path.rstrip('/')}/_SUCCESS"):
        df.write.mode("overwrite").partitionBy(*by).parquet(path)
        return True
    there = spark.read.schema(df.schema).parquet(path).select(df.columns)
    if not df.exceptAll(there).isEmpty() or not there.exceptAll(df).isEmpty():
        raise ValueError(f"{path} holds other rows; choose another path")
    return False


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One CSV file with a header and a fixed list of columns; arrays, maps and structs as JSON. For report-sized tables."""
    kinds = dict(df.dtypes)
    flat = [F.to_json(c).alias(c) if kinds[c].startswith(("array", "map", "struct")) else F.col(c) for c in columns]
    df.select(*flat).coalesce(1).write.mode("overwrite").option("header", "true").option("escape", '"').csv(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per row; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A Markdown table of a small result; longer ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows are no summary")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in lines) + "\n"


def write_text(path: str, text: str, root: str) -> None:
    """Replace a small local text file at once; the path must stay inside ``root`` and be no link."""
    target = Path(path)
    if target.is_symlink() or not target.parent.resolve().is_relative_to(Path(root).resolve()):
        raise ValueError(f"{path} is outside {root}")
    pending = target.with_name(target.name + ".pending")
    with pending.open("w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    pending.replace(target)


def resume(work: DataFrame, path: str, key: str, process: Callable[[DataFrame], DataFrame]) -> int:
    """Process the rows of ``work`` whose key isn't in the table at ``path`` and append them; returns how many were left to do."""
    spark = work.sparkSession
    done = _exists(spark, f"{path.rstrip('/')}/_SUCCESS")
    todo = work.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti") if done else work
    n = todo.count()
    if n or not done:
        process(todo).write.mode("append").parquet(path)
    return n


def quarantine(checked: DataFrame, good_path: str, bad_path: str, error: str = "error") -> None:
    """Rows without ``error`` go to one table, the others with their error to another; none is lost."""
    checked.filter(F.col(error).isNull()).drop(error).write.mode("overwrite").parquet(good_path)
    checked.filter(F.col(error).isNotNull()).write.mode("overwrite").parquet(bad_path)
