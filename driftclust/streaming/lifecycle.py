"""Lifecycles kept by Structured Streaming: what is known of each stream key and cluster, or waiting item, by slots with a state and an event-time timer."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Where Spark keeps state that has timers.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Slots that keys are dealt to.
SLOTS = 1024

_CHANGES = "stream_key string, cluster_id string, type string, at long, size long"
_ORPHANS = "stream_key string, item_id string, at long"


def _micros(span: timedelta) -> int:
    return span // timedelta(microseconds=1)


def _timer(at: int) -> int:
    """The millisecond by which a moment in microseconds has passed."""
    return -(-at // 1000)


class _Slots(StatefulProcessor):
    """The keys (stream_key and another) that hash to one slot, with one state and one timer for all of them: what is kept for each key is a tuple, and
    the state is those tuples as an Arrow table, so a batch costs a few calls a slot, not for each key."""

    #: Names and types of what is kept for each key.
    KEPT: tuple[tuple[str, pa.DataType], ...]
    #: Names of the columns of the result.
    OUT: tuple[str, ...]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("slot", "kept binary")

    def _load(self) -> dict[tuple[str, str], tuple]:
        if not self.state.exists():
            return {}
        table = pa.ipc.open_stream(self.state.get()[0]).read_all()
        columns = [c.to_pylist() for c in table.columns]
        return dict(zip(zip(*columns[:2]), zip(*columns[2:])))

    def _store(self, kept: dict[tuple[str, str], tuple]) -> None:
        names = [("stream_key", pa.string()), ("key", pa.string()), *self.KEPT]
        columns = [*zip(*kept), *zip(*kept.values())] if kept else [()] * len(names)
        table = pa.table([pa.array(c, t) for c, (_, t) in zip(columns, names)], [n for n, _ in names])
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as writer:
            writer.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(),))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        due = min((d for v in kept.values() if (d := self._due(v)) is not None), default=None)
        if due is not None:
            self.handle.registerTimer(_timer(due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        kept, out = self._load(), []
        met: dict[tuple[str, str], list] = {}
        for part in rows:
            for stream_key, name, *values in zip(*(part[c].tolist() for c in ("stream_key", "key", *self.IN))):
                met.setdefault((stream_key, name), []).append(values)
        for name, values in met.items():
            kept[name] = self._take(name, kept.get(name), values, out)
        self._store(kept)
        yield pd.DataFrame(out, columns=self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        kept, out = self._load(), []
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs())
        for name, value in kept.items():
            due = self._due(value)
            if due is not None and _timer(due) <= now:
                kept[name] = self._expire(name, value, out)
        self._store(kept)
        yield pd.DataFrame(out, columns=self.OUT)

    def close(self) -> None:
        pass


class Quiet(_Slots):
    """Closes a cluster when event time has passed ``after`` since its last item, and opens it again by a later one. Kept: the last item's time, the
    items so far, whether it is open."""

    IN, KEPT = ("at",), (("last", pa.int64()), ("size", pa.int64()), ("open", pa.bool_()))
    OUT = ("stream_key", "cluster_id", "type", "at", "size")

    def __init__(self, after: int):
        self.after = after

    def _due(self, value: tuple) -> int | None:
        return value[0] + self.after if value[2] else None

    def _take(self, name: tuple[str, str], value: tuple | None, rows: list, out: list) -> tuple:
        last, size, is_open = value or (None, 0, False)
        for (t,) in sorted(rows):
            if is_open and t - last >= self.after:
                out.append((*name, "cluster.closed", last + self.after, size))
                is_open = False
            size += 1
            if not is_open:
                if last is None or t > last:  # a late item doesn't open what its successors have seen closed
                    out.append((*name, "cluster.opened" if last is None else "cluster.reopened", t, size))
                    is_open = True
            last = t if last is None else max(last, t)
        return last, size, is_open

    def _expire(self, name: tuple[str, str], value: tuple, out: list) -> tuple:
        last, size, _ = value
        out.append((*name, "cluster.closed", last + self.after, size))
        return last, size, False


class Waiting(_Slots):
    """Orphans a buffered item when event time is past its own by more than ``age``, unless it has been assigned. Kept: its time, whether it is settled."""

    IN, KEPT = ("at", "waits"), (("at", pa.int64()), ("settled", pa.bool_()))
    OUT = ("stream_key", "item_id", "at")

    def __init__(self, age: int):
        self.age = age

    def _due(self, value: tuple) -> int | None:
        return None if value[1] else value[0] + self.age + 1

    def _take(self, name: tuple[str, str], value: tuple | None, rows: list, out: list) -> tuple:
        at, settled = value or (None, False)
        first = min(t for t, _ in rows)
        return first if at is None else min(at, first), settled or not all(waits for _, waits in rows)

    def _expire(self, name: tuple[str, str], value: tuple, out: list) -> tuple:
        out.append((*name, value[0]))
        return value[0], True


def _run(stream: DataFrame, key: str, processor: StatefulProcessor, schema: str, slots: int) -> DataFrame:
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    dealt = stream.withColumnRenamed(key, "key").withColumn("slot", F.pmod(F.xxhash64("stream_key", "key"), F.lit(slots)))
    found = dealt.groupBy("slot").transformWithStateInPandas(statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime")
    return found.withColumn("at", F.timestamp_micros("at"))


def _keyed(stream: DataFrame, lateness: str, *columns) -> DataFrame:
    key = F.col("stream_key").cast("string") if "stream_key" in stream.columns else F.lit("")
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", lateness)
    return timed.select(F.coalesce(key, F.lit("")).alias("stream_key"), *columns, F.unix_micros("ts").alias("at"), "ts").where("ts IS NOT NULL")


def cluster_changes(stream: DataFrame, close_after: timedelta, lateness: str = "0 seconds", slots: int = SLOTS) -> DataFrame:
    """(stream_key, cluster_id, type, at, size): clusters opened by their first item, closed ``close_after`` after their last, at that very moment, and
    reopened, from a stream of assignments (stream_key, cluster_id, ts).

    Each stream key has clusters of its own; without the column there is one key. State and timers are kept by slots of a hash of key and cluster, whose
    number must stay the same for a checkpoint; the more clusters a stream has, the more slots it should have. Closings come when the watermark,
    ``lateness`` behind the newest item of any key, has passed them, or with the item that shows the pause. Rows without cluster or time
    count for nothing. What a batch of the stream holds in any order counts in that of its times; a later batch's older items count, but open nothing.
    """
    rows = _keyed(stream, lateness, F.col("cluster_id").cast("string").alias("cluster_id")).where("cluster_id IS NOT NULL")
    return _run(rows, "cluster_id", Quiet(_micros(close_after)), _CHANGES, slots)


def orphans(stream: DataFrame, max_age: timedelta, lateness: str = "0 seconds", slots: int = SLOTS) -> DataFrame:
    """(stream_key, item_id, at): items that wait for longer than ``max_age``, from a stream of their states (stream_key, item_id, ts, status). A
    status other than buffered, at any time, ends the waiting."""
    rows = _keyed(stream, lateness, F.col("item_id").cast("string").alias("item_id"), (F.coalesce(F.col("status"), F.lit("")) == "buffered").alias("waits")).where("item_id IS NOT NULL")
    return _run(rows, "item_id", Waiting(_micros(max_age)), _ORPHANS, slots)
