"""Record files as a stream: each record once, counts per window with late rows, quota per sample."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import scratch_path


def record_stream(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet record files of a folder as they arrive; the checkpoint of the query remembers which are done.

    A path to one file reads that file only.
    """
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)


def once_per_sample(stream: DataFrame, at: str = "written_at", delay: str = "70 days") -> DataFrame:
    """The first delivery of each sample; state is dropped after ``delay``, which must cover late second deliveries."""
    timed = stream.withColumn("event_time", F.col(at).cast("timestamp"))
    return timed.withWatermark("event_time", delay).dropDuplicatesWithinWatermark(["sample_id"])


def windowed_counts(stream: DataFrame, at: str, window: str, delay: str, by: str) -> DataFrame:
    """(start, by, n): rows per tumbling window; rows later than ``delay`` are dropped by the watermark."""
    timed = stream.withColumn("event_time", F.col(at).cast("timestamp"))
    counted = timed.withWatermark("event_time", delay).groupBy(F.window("event_time", window).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").alias("start"), by, "n")


_OUT = "sample_id string, seen bigint, correct bigint, wrong bigint, reached boolean"


def running_quota(stream: DataFrame, target: int) -> DataFrame:
    """Per sample, after each batch, how many correct and wrong evaluations came so far and whether both reached ``target``.

    ``stream`` has (sample_id, score). State is two counters per sample.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        good, bad = state.get if state.exists else (0, 0)
        for f in frames:
            good += int((f["score"] == 1.0).sum())
            bad += int((f["score"] == 0.0).sum())
        state.update((good, bad))
        yield pd.DataFrame({"sample_id": [key[0]], "seen": [good + bad], "correct": [good], "wrong": [bad], "reached": [min(good, bad) >= target]})

    return stream.select("sample_id", "score").groupBy("sample_id").applyInPandasWithState(step, _OUT, "correct bigint, wrong bigint", "update", "NoTimeout")


def drained(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into a written table of the shared scratch folder and return its scan.

    In mode "complete" each batch writes the whole result, and the last one counts; a batch
    that is repeated after a failure overwrites its own.
    """
    spark = stream.sparkSession
    path, mark = scratch_path(spark, tag), scratch_path(spark, f"{tag}-mark")
    writer, last = stream.writeStream.option("checkpointLocation", mark).trigger(availableNow=True), []
    if mode == "complete":

        def keep(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{path}/{number}")
            last.append(number)

        query = writer.outputMode("complete").foreachBatch(keep).start()
    else:
        query = writer.format("parquet").outputMode(mode).start(path)
    query.awaitTermination()
    if mode == "complete" and not last:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{path}/{last[-1]}" if last else path)


def drain(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there now into an in-memory table of the driver and return it: for tests only."""
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
