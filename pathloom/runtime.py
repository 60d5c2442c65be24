"""Session helpers shared by all operators: table access and shared scratch tables.

Intermediate results that several stages read are written as Parquet under the
folder the cluster names in ``spark.checkpoint.dir``; every executor can read it,
so a lost executor costs a re-read and never a recomputation from the sources.
"""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows with one key beyond which ``hot_joined`` spreads them.
HOT_ROWS = 100_000


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python workers (once per context)."""
    sc = spark.sparkContext
    if getattr(ship, "done", None) != sc.applicationId:
        package = Path(__file__).resolve().parent
        into = tempfile.mkdtemp(prefix="pathloom-package-")  # the driver serves it from here
        atexit.register(shutil.rmtree, into, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{into}/{package.name}", "zip", package.parent, package.name))
        ship.done = sc.applicationId


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def discard(df: DataFrame) -> None:
    """Remove the files of a table made by ``written`` that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
        if f"-{os.getpid()}-" in folder.rpartition("/")[2]:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def is_local(master: str) -> bool:
    """Whether all executors of ``master`` are threads of one process on this machine."""
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for written intermediates and checkpoints.

    The cluster's own setting wins. Only a session on one machine that names none (tests)
    gets a temporary folder of this process; on a cluster that is an error.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not is_local(sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = getattr(scratch_root, "own", None)
        if root is None:
            own = tempfile.mkdtemp(prefix="pathloom-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
            root = scratch_root.own = f"file://{own}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new, unused path for one written intermediate."""
    return f"{scratch_root(spark).rstrip('/')}/{tag}-{os.getpid()}-{uuid.uuid4().hex}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once to the shared scratch folder and return a scan of it."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hot_joined(rows: DataFrame, other: DataFrame, key: list[str], counts: DataFrame | None = None) -> DataFrame:
    """The inner equi-join of ``rows`` and ``other`` on ``key``, in which keys with very many ``rows`` are spread over several tasks.

    Keys are counted first, combined before the shuffle (unless ``counts`` has ``key`` and ``n``). One with more than HOT_ROWS rows is
    split by a hash of the rows into as many parts as it needs, and its rows of ``other`` are
    repeated for each part. There are fewer such keys than rows / HOT_ROWS, so their list can be
    broadcast. Null keys match nothing. Columns other than ``key`` must have different names.
    """
    part, parts = "part_of_key", "parts_of_key"
    while {part, parts} & {*rows.columns, *other.columns}:
        part, parts = part + "_", parts + "_"
    counts = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n")) if counts is None else counts
    hot = counts.select(*key, F.col("n").alias(parts)).filter(F.col(parts) > HOT_ROWS).withColumn(parts, F.ceil(F.col(parts) / F.lit(HOT_ROWS)).cast("int"))
    hot = F.broadcast(hot)
    of_row = [F.col(c) for c, kind in rows.dtypes if "map<" not in kind and "variant" not in kind]
    split = rows.join(hot, key, "left").withColumn(part, F.coalesce(F.pmod(F.xxhash64(*of_row), F.col(parts)).cast("int"), F.lit(0))).drop(parts)
    whole = other.join(hot, key, "left").withColumn(part, F.explode(F.sequence(F.lit(0), F.coalesce(parts, F.lit(1)) - 1))).drop(parts)
    return split.join(whole, [*key, part]).drop(part)


def drop_scratch(spark: SparkSession) -> None:
    """Remove the intermediates that this process has written; results that still read them become unusable."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(scratch_root(spark))
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for status in fs.listStatus(root) if fs.exists(root) else ():
        if f"-{os.getpid()}-" in status.getPath().getName():
            fs.delete(status.getPath(), True)


def parallelism(spark: SparkSession) -> int:
    """Shuffle partitions the session asks for, never under its cores."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), spark.sparkContext.defaultParallelism)
