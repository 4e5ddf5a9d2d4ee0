"""Structured Streaming into the engine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from driftclust.scheduler import JobPlan


def ingest_stream(engine, stream: DataFrame, checkpoint: str, name: str = "ingest", interval: str | None = None, jobs: JobPlan | None = None) -> StreamingQuery:
    """Ingest each micro-batch of a stream (id, text, ts, metadata). A batch is named by its number, so one that Spark repeats after a
    failure is skipped; ids dedupe for ever, and late items are kept. With a job plan, due jobs run between batches.

    Without an interval everything available is ingested, then the query ends.
    """

    def sink(batch: DataFrame, number: int) -> None:
        engine.ingest(batch, batch=f"{name}-{number}")
        if jobs is not None:
            jobs.at(now := engine.clock.now())
            jobs.after_ingest(now)

    writer = stream.writeStream.queryName(name).option("checkpointLocation", checkpoint).foreachBatch(sink)
    writer = writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)
    return writer.start()
