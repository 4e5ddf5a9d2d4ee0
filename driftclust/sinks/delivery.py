"""Webhooks: committed events are posted by Spark tasks, each cluster's in order, and what became of them is a table."""

from __future__ import annotations

import hashlib
import hmac
import json
import os
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds before the second attempt; each further one waits twice as long.
FIRST_WAIT = 0.5
OUTCOMES = "seq long, outcome string, attempts int, status int"


def signature(secret: str, body: bytes) -> str:
    return "sha256=" + hmac.new(secret.encode(), body, hashlib.sha256).hexdigest()


def post(url: str, body: bytes, headers: dict[str, str], seconds: float) -> int:
    """The answer's status, 0 where there was none."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, body, headers), timeout=seconds) as answer:
            return answer.status
    except urllib.error.HTTPError as answer:
        return answer.code
    except (OSError, ValueError):  # no connection, or an answer that is no HTTP
        return 0


@dataclass(frozen=True)
class Hook:
    """Where events go, which ones (all if None), signed with what."""

    url: str
    types: tuple[str, ...] | None = None
    secret: str | None = None
    tries: int = 6
    seconds: float = 5.0

    def __post_init__(self):
        if urllib.parse.urlsplit(self.url).scheme not in ("http", "https"):
            raise ValueError(f"a webhook needs an address of http or https, not {self.url!r}")

    @property
    def name(self) -> str:
        """The folder of its outcomes: another address or choice of events is another hook."""
        return hashlib.sha256(json.dumps([self.url, sorted(self.types or ())]).encode()).hexdigest()[:16]


def hook_of(settings) -> Hook:
    """From a ``config.Webhook``; its secret is in the environment."""
    secret = os.environ.get(settings.secret_env) if settings.secret_env else None
    if settings.secret_env and not secret:
        raise ValueError(f"the variable {settings.secret_env} holds no secret")
    return Hook(settings.url, tuple(settings.event_types) if settings.event_types else None, secret, settings.max_retries + 1, settings.timeout.total_seconds())


def posting(hook: Hook, send: Callable[..., int] = post, wait: Callable[[float], None] = time.sleep) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its rows (seq, type, body): post them one by one, and again where the receiver may yet take them, which is where there was
    no answer or one of 429 or from 500 on. An outcome is sent, refused or given up."""

    def one(kind: str, body: bytes) -> tuple[str, int, int]:
        headers = {"Content-Type": "application/json", "X-Event": kind} | ({"X-Signature": signature(hook.secret, body)} if hook.secret else {})
        status = 0
        for attempt in range(1, hook.tries + 1):
            if attempt > 1:
                wait(FIRST_WAIT * 2 ** (attempt - 2))
            status = send(hook.url, body, headers, hook.seconds)
            if 200 <= status < 400:
                return "sent", attempt, status
            if 400 <= status < 500 and status != 429:
                return "refused", attempt, status
        return "given up", hook.tries, status

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(kind, body.encode()) for kind, body in zip(batch.column("type").to_pylist(), batch.column("body").to_pylist())]
            columns = list(zip(*out)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([batch.column("seq"), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int32())], ["seq", "outcome", "attempts", "status"])

    return run


def bodies(events: DataFrame) -> DataFrame:
    """Events with their JSON, keys in order: cluster_id, data, item_id, seq, ts, type."""
    offset = F.regexp_replace(F.date_format("ts", "xxx"), "^Z$", "+00:00")
    second = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    ts = F.concat(F.regexp_replace(second, r"\.000000$", ""), offset)
    text = lambda c: F.coalesce(F.to_json(F.array(c)), F.lit("[null]"))
    inner = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    rows = events.withColumn("__cluster", text("cluster_id")).withColumn("__item", text("item_id")).withColumn("__type", text("type"))
    body = F.concat(F.lit('{"cluster_id": '), inner("__cluster"), F.lit(', "data": '), F.coalesce("data", F.lit("{}")), F.lit(', "item_id": '), inner("__item"), F.lit(', "seq": '), F.col("seq").cast("string"), F.lit(', "ts": "'), ts, F.lit('", "type": '), inner("__type"), F.lit("}"))
    return rows.withColumn("body", body).drop("__cluster", "__item", "__type")


class Delivery:
    """Sends committed events to a hook and keeps what became of each under ``folder``, in one table for all that was due at a time.

    Tasks have whole clusters (or items, for events without a cluster) and post their events by seq. A task that is lost runs again alone; a run that
    fails as a whole leaves no outcomes, and the next one begins where the last whole one ended. So an event is posted once or, after a
    failure, more often, and ``seq`` tells a receiver which it knows.
    """

    def __init__(self, spark: SparkSession, hook: Hook, folder: str):
        self.spark, self.hook, self.path = spark, hook, f"{folder.rstrip('/')}/{hook.name}"

    def outcomes(self) -> DataFrame:
        """(seq, outcome, attempts, status, upto) of all events so far; upto is the last seq that was due in a run."""
        try:
            return self.spark.read.schema(f"{OUTCOMES}, upto long").parquet(self.path)
        except AnalysisException:  # none so far
            return self.spark.createDataFrame([], f"{OUTCOMES}, upto long")

    def done(self) -> int:
        """The last seq that was due in a whole run."""
        return self.outcomes().agg(F.max("upto")).first()[0] or 0

    def run(self, events: DataFrame, send: Callable[..., int] = post, wait: Callable[[float], None] = time.sleep) -> dict[str, int]:
        """Post what is new in ``events`` (seq, type, ts, cluster_id, item_id, data) and count the outcomes."""
        new = events.where(F.col("seq") > self.done())
        if self.hook.types is not None:
            new = new.where(F.col("type").isin(*self.hook.types))
        last = new.agg(F.max("seq")).first()[0]
        if last is None:
            return {}
        rows = bodies(new.where(F.col("seq") <= last)).select("seq", "type", "body", F.coalesce("cluster_id", F.concat(F.lit("item:"), F.col("item_id")), F.lit("")).alias("__of"))
        rows = rows.repartition("__of").sortWithinPartitions("seq").select("seq", "type", "body")
        rows.mapInArrow(posting(self.hook, send, wait), OUTCOMES).withColumn("upto", F.lit(last).cast("long")).write.mode("append").partitionBy("upto").parquet(self.path)
        return {r.outcome: r["count"] for r in self.outcomes().where(F.col("upto") == last).groupBy("outcome").count().collect()}
