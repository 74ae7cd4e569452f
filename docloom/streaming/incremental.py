"""Incremental work that survives a crash, and event-time windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def process_new(spark: SparkSession, source: str, schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Applies work to the JSON-lines files that came to source since the last call and appends the rows to out.

    The checkpoint keeps what is done: a run that dies goes on where it stopped, and no file counts twice.
    """
    found = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).json(source)
    query = work(found).writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()


def windows(events: DataFrame, ts: str, by: str, value: str, width: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums of events in windows of event time, by group; the same for batches and streams."""
    timed = events.withColumn("time_", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("time_", late) if events.isStreaming else timed
    w = F.window("time_", width, slide) if slide else F.window("time_", width)
    return timed.groupBy(w.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def sessions(events: DataFrame, ts: str, by: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of each group: events no further apart than gap."""
    timed = events.withColumn("time_", F.col(ts).cast("timestamp"))
    timed = timed.withWatermark("time_", late) if events.isStreaming else timed
    return timed.groupBy(F.session_window("time_", gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def deduplicated(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """Events without repeats of keys inside the watermark."""
    timed = events.withColumn("time_", F.col(ts).cast("timestamp"))
    return (timed.withWatermark("time_", late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else timed.dropDuplicates(keys)).drop("time_")
