"""Problem 3: a stratified sample that never changes when data grow.

A record's key is hashed with a salt to a number in [0, 1); a row passes if that number is
below the rate of its stratum, and a record is chosen with all its deliveries if any passes.
Nothing depends on order, partitioning or other rows. Rates are only ever raised, which is
checked against the stored ones, so a chosen record stays chosen, whatever is added.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import hot_joined

#: Hex digits of the hash that make the fraction: 52 bits, exact in a double.
DIGITS = 13

def fraction(key: Column, salt: str) -> Column:
    """A reproducible number in [0, 1) of a string key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(salt + "|"), key), 256), 1, DIGITS), 16, 10).cast("bigint") / F.lit(float(16**DIGITS))


@dataclass(frozen=True)
class Rates:
    """Sampling rates by stratum, with the rate of every stratum that isn't named."""

    named: Mapping[str, float]
    default: float = 0.0

    def __post_init__(self) -> None:
        for rate in (*self.named.values(), self.default):
            if not 0 <= rate <= 1:
                raise ValueError(f"a rate must lie between 0 and 1: {rate}")

    def of(self, stratum: str) -> float:
        return self.named.get(stratum, self.default)

    def raised(self, new: Rates) -> Rates:
        """``new``, if it lowers no stratum, named or not: a record chosen before would be lost. Else an error."""
        lower = sorted(s for s in {*self.named, *new.named} if new.of(s) < self.of(s))
        if lower or new.default < self.default:
            raise ValueError(f"rates may only rise; lowered: {', '.join(lower) or 'the default'}")
        return new

    def column(self, stratum: Column) -> Column:
        """The rate of each row's stratum."""
        if not self.named:
            return F.lit(float(self.default))
        return F.coalesce(F.element_at(F.create_map(*(F.lit(x) for k, v in sorted(self.named.items()) for x in (k, float(v)))), stratum), F.lit(float(self.default)))


def stored_rates(spark: SparkSession, path: str) -> Rates | None:
    """The rates of the last sample that was drawn with ``path``, or nothing."""
    import json

    if not spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)):
        return None
    rows = spark.read.text(path).collect()  # one line
    got = json.loads(rows[0].value)
    return Rates(got["named"], got["default"])


def store_rates(spark: SparkSession, path: str, rates: Rates) -> Rates:
    """Keep ``rates`` in ``path`` for later samples; refused if a rate is lower than the stored one."""
    import json

    old = stored_rates(spark, path)
    rates = old.raised(rates) if old else rates
    spark.createDataFrame([(json.dumps({"named": dict(rates.named), "default": rates.default}, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return rates


def stratum(*columns: str) -> Column:
    """The stratum of a row: its values joined with "|", null as an empty value."""
    return F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))


def chosen_keys(df: DataFrame, key: str, strata: list[str], rates: Rates, salt: str = "sample") -> DataFrame:
    """The distinct chosen keys. Rows without key are never chosen."""
    return df.filter(F.col(key).isNotNull() & (fraction(F.col(key), salt) < rates.column(stratum(*strata)))).select(F.col(key)).distinct()


def stable_sample(df: DataFrame, key: str, strata: list[str], rates: Rates, before: Rates | None = None, salt: str = "sample") -> DataFrame:
    """All rows of ``df`` whose record is chosen, with all columns.

    ``before`` are the rates of the last sample (``stored_rates``): lower ones are refused, so that
    every record chosen then stays chosen. Every delivery of a chosen key is taken, also one in
    another stratum. The chosen keys are combined before the shuffle; a key with very many
    deliveries is spread. An empty table gives no rows.
    """
    rates = before.raised(rates) if before else rates
    as_key = "chosen_key"
    while as_key in df.columns:  # never hide a column of the caller
        as_key += "_"
    keys = chosen_keys(df, key, strata, rates, salt).select(F.col(key).alias(as_key))
    return hot_joined(df.withColumn(as_key, F.col(key)), keys, [as_key]).select(*df.columns)


def growth_replay(df: DataFrame, key: str, at: str, strata: list[str], rates: Rates, salt: str = "sample") -> DataFrame:
    """(month, records, chosen, kept): the sample after each month of arrivals.

    ``records`` and ``chosen`` count all that arrived up to the month's end; ``kept`` counts the
    records chosen at an earlier month's end that are chosen still, which must be all of them.
    Rows without time or key are left out.
    """
    month = F.date_format(F.col(at), "yyyy-MM")
    rows = df.filter(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key).alias("k"), month.alias("month"), (fraction(F.col(key), salt) < rates.column(stratum(*strata))).alias("hit"))
    records = rows.groupBy("k").agg(F.min("month").alias("first"), F.min(F.when(F.col("hit"), F.col("month"))).alias("hit_from"))
    arrivals = records.groupBy(F.col("first").alias("month")).agg(F.count(F.lit(1)).alias("new"))
    hits = records.filter("hit_from is not null").groupBy(F.col("hit_from").alias("month")).agg(F.count(F.lit(1)).alias("new_hits"))
    months = arrivals.join(hits, "month", "full").na.fill(0)
    # months are few, whatever the data: their running sums fit one task
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    out = months.select("month", F.sum("new").over(w).alias("records"), F.sum("new_hits").over(w).alias("chosen"), "new_hits")
    return out.select("month", "records", "chosen", (F.col("chosen") - F.col("new_hits")).alias("kept"))
