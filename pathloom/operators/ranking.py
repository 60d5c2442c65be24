"""Positions and picks that never put a whole group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import parallelism, written


def numbered(df: DataFrame, group: list[str], order: list[Column], position: str = "position", index: str = "global_index") -> DataFrame:
    """``df`` with its 0-based position in its group and its index over all rows, ordered by group and ``order``.

    Rows are range-partitioned and sorted once and written; each partition's count per group
    (a few rows per partition) gives the offsets. Five groups of billions of rows are numbered
    by all tasks, where ROW_NUMBER would use five. ``order`` must be unique within a group.
    """
    keys = {f"__o{i}": o for i, o in enumerate(order)}
    src = df.withColumns(keys)
    by = [F.col(g) for g in group] + [F.col(k) for k in keys]
    src = src.repartitionByRange(parallelism(df.sparkSession), *by).sortWithinPartitions(*by)
    src = written(src.withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}).drop(*keys), "ranked")
    part = src.groupBy("__part", *group).agg(F.count(F.lit(1)).alias("__n"), F.min("__row").alias("__first"))
    all_ = Window.orderBy("__part", "__first").rowsBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy(*group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("bigint")
    offset = part.select("__part", *[F.col(g).alias(f"__g_{g}") for g in group], "__first", F.coalesce(F.sum("__n").over(own), zero).alias("__own"), F.coalesce(F.sum("__n").over(all_), zero).alias("__all"))
    joined = src.alias("s").join(offset.alias("o"), _on(group))
    at = F.col("s.__row") - F.col("o.__first")
    return joined.select(*[F.col(f"s.{c}") for c in df.columns], (at + F.col("o.__own")).alias(position), (at + F.col("o.__all")).alias(index))


def _on(group: list[str]) -> Column:
    on = F.col("s.__part") == F.col("o.__part")
    for g in group:
        on = on & F.col(f"s.{g}").eqNullSafe(F.col(f"o.__g_{g}"))
    return on


def first_by(df: DataFrame, key: list[str], order: Column, last: bool = False, keep: list[str] | None = None) -> DataFrame:
    """One row per key, the first (or last) by ``order``; combined before the shuffle, so hot keys are cheap.

    Columns can't be pruned through the aggregation: name those wanted in ``keep``.
    """
    row = F.struct(*[F.col(c) for c in keep or df.columns])
    pick = (F.max_by if last else F.min_by)(row, order)
    return df.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(key)]).agg(pick.alias("__row")).select("__row.*")


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first ``n`` rows per group with their 1-based rank; Spark limits each group before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col(rank) <= n)
