"""Structured Streaming forms of the stateful operators, with event time and watermarks."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftclust.session import shared_folder

#: How long late events are waited for.
LATENESS = "3650 days"


def timed(stream: DataFrame, column: str = "ts", lateness: str = LATENESS) -> DataFrame:
    """A stream whose event time is zoned, as watermarks need it."""
    return stream.withColumn(column, F.col(column).cast("timestamp")).withWatermark(column, lateness)


def windowed_counts(stream: DataFrame, key: str, width: str, lateness: str = LATENESS) -> DataFrame:
    """(key, start, n) by tumbling window."""
    counts = timed(stream, lateness=lateness).groupBy(key, F.window("ts", width)).agg(F.count("*").alias("n"))
    return counts.select(key, F.col("window.start").alias("start"), "n")


def deduplicated(stream: DataFrame, keys: list[str], lateness: str = LATENESS) -> DataFrame:
    """First occurrences; the state of a key is dropped once the watermark has passed it by ``lateness``."""
    return timed(stream, lateness=lateness).dropDuplicatesWithinWatermark(keys).select(*keys)


def streamed_sessions(stream: DataFrame, key: str, gap: timedelta, lateness: str = LATENESS) -> DataFrame:
    """(key, start, end, n): runs of events with no pause longer than the gap."""
    window = F.session_window("ts", f"{int(gap.total_seconds() * 1000)} milliseconds")
    return timed(stream, lateness=lateness).groupBy(key, window.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("w")


def run_available(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is there and return the result. For tests and batch use of streaming plans; the result is written to the
    shared folder by ``foreachBatch``, each batch to a folder of its own, so a repeated batch replaces itself."""
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"

    def sink(batch: DataFrame, number: int) -> None:
        folder = f"{out}/result" if mode == "complete" else f"{out}/result/batch={number}"
        batch.write.mode("overwrite").parquet(folder)

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(sink).start().awaitTermination()
    result = spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{out}/result")
    return result
