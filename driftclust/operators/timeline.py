"""Intervals and sessions from event logs."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STARTS, ENDS = ("cluster.opened", "cluster.reopened"), ("cluster.closed", "cluster.merged")


def open_segments(events: DataFrame) -> DataFrame:
    """(cluster_id, start, end, open_at_end): when clusters were open, from events (seq, type, ts, cluster_id).

    A segment starts at the first opened or reopened event after the last end, and ends at a closed or merged event; one without an end
    runs to the last event of all.
    """
    by = W.partitionBy("cluster_id").orderBy("seq")
    marked = events.where(F.col("type").isin(*STARTS, *ENDS) & F.col("cluster_id").isNotNull()).withColumn("is_end", F.col("type").isin(*ENDS))
    islands = marked.withColumn("island", F.coalesce(F.sum(F.col("is_end").cast("int")).over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    found = islands.groupBy("cluster_id", "island").agg(F.min_by(F.when(~F.col("is_end"), F.col("ts")), F.when(~F.col("is_end"), F.col("seq"))).alias("start"), F.max(F.when(F.col("is_end"), F.col("ts"))).alias("end"))
    last = events.agg(F.max("ts").alias("last"))
    return found.where("start is not null").crossJoin(F.broadcast(last)).select("cluster_id", "start", F.coalesce("end", "last").alias("end"), F.col("end").isNull().alias("open_at_end"))  # one row on the right


def sessions(events: DataFrame, key: str, gap: timedelta) -> DataFrame:
    """(key, start, end, n): runs of events (key, ts) with no pause longer than the gap; start and end are the first and last event."""
    window = F.session_window(F.col("ts").cast("timestamp"), f"{int(gap.total_seconds() * 1000)} milliseconds")
    return events.groupBy(key, window.alias("w")).agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count("*").alias("n")).drop("w")


def final_closes(events: DataFrame) -> DataFrame:
    """(cluster_id, closed_at): the last closed event of clusters that weren't reopened after it."""
    last = events.where(F.col("type").isin("cluster.closed", "cluster.reopened")).groupBy("cluster_id").agg(F.max_by(F.struct("type", "ts"), "seq").alias("e"))
    return last.where(F.col("e.type") == "cluster.closed").select("cluster_id", F.col("e.ts").alias("closed_at"))


def batch_numbers(events: DataFrame, window: timedelta, most: int, key: str | None = None, time: str = "ts", item: str = "event_id") -> DataFrame:
    """``events`` with ``batch``: the number of its greedy batch in the order of time and item, within each key.

    Each batch starts where the one before it ended, so the cut is a fold over ordered rows; it streams through sorted partitions,
    one key after the other, and holds no more than the start of the batch.
    """
    import pyarrow as pa

    limit = int(window.total_seconds() * 1_000_000)

    def cut(batches):
        now, number, start, size = object(), 0, None, 0
        for part in batches:
            keys, micros, out = part.column("__key").to_pylist(), part.column("__micros").to_pylist(), []
            for k, t in zip(keys, micros, strict=True):
                if k != now:
                    now, number, start, size = k, 0, t, 0
                elif t - start >= limit or size >= most:
                    number, start, size = number + 1, t, 0
                size += 1
                out.append(number)
            yield pa.RecordBatch.from_arrays([part.column(item), part.column("__key"), pa.array(out, pa.int64())], [item, "__key", "batch"])

    keyed = events.select(item, (F.col(key) if key else F.lit("")).cast("string").alias("__key"), F.unix_micros(F.col(time).cast("timestamp")).alias("__micros"))
    keyed = keyed.repartition("__key").sortWithinPartitions("__key", "__micros", item)
    numbered = keyed.mapInArrow(cut, f"{item} {events.schema[item].dataType.simpleString()}, __key string, batch long")
    return events.join(numbered.drop("__key"), item)
