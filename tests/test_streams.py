"""Lifecycles by timers of Structured Streaming, for two tenants and over several batches."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftclust.streaming.lifecycle import cluster_changes, orphans
from driftclust.streaming.windows import run_available

T0 = datetime(2024, 1, 1, tzinfo=UTC)
HOUR = timedelta(hours=1)


def streamed(spark, folder, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/{i:03}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}")


def changes(rows, after, end):
    """Tenant by tenant and cluster by cluster, in order of time."""
    out, seen = [], {}
    for key, cluster, ts in rows:
        if cluster is not None and ts is not None:
            seen.setdefault((key or "", cluster), []).append(ts)
    for (key, cluster), times in seen.items():
        times.sort()
        for i, t in enumerate(times):
            if i == 0 or t - times[i - 1] >= after:
                out.append((key, cluster, "cluster.reopened" if i else "cluster.opened", t, i + 1))
            if t + after <= (times[i + 1] if i + 1 < len(times) else end):
                out.append((key, cluster, "cluster.closed", t + after, i + 1))
    return sorted(out, key=str)


@pytest.mark.parametrize("n_batches", [1, 4])
def test_clusters_of_two_tenants_open_and_close(spark, tmp_path, n_batches):
    r = random.Random(n_batches)
    rows = [(r.choice(["north", "south"]), r.choice(["c1", "c2", "c3"]), T0 + timedelta(minutes=r.randrange(60 * 24 * 12))) for _ in range(120)]
    rows += [("south", None, T0), ("north", "c1", None), (None, "c1", T0 + 30 * HOUR)]
    rows.sort(key=lambda x: x[2] or T0)
    size = -(-len(rows) // n_batches)
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    for b in batches:
        r.shuffle(b)
    stream = streamed(spark, tmp_path / "in", batches, "stream_key string, cluster_id string, ts timestamp")
    got = [(x.stream_key, x.cluster_id, x.type, x.at.replace(tzinfo=UTC), x.size) for x in run_available(spark, cluster_changes(stream, 20 * HOUR), "append").collect()]
    end = max(x[2] for x in rows if x[2])
    assert sorted(got, key=str) == changes(rows, 20 * HOUR, end)
    assert {x[0] for x in got} == {"north", "south", ""} and any(x[2] == "cluster.reopened" for x in got)


def test_items_wait_until_they_are_assigned_or_too_old(spark, tmp_path):
    rows = [[("a", f"i{n}", T0 + n * HOUR, "buffered") for n in range(10)] + [("b", "i3", T0, "buffered")], [("a", "i2", T0 + 11 * HOUR, "assigned"), ("a", "i1", T0 + 12 * HOUR, None)], [("b", "late", T0 + 30 * HOUR, "buffered"), ("b", None, T0, "buffered")], [("a", "i4", T0 + 31 * HOUR, "assigned")]]
    stream = streamed(spark, tmp_path / "in", rows, "stream_key string, item_id string, ts timestamp, status string")
    got = {(x.stream_key, x.item_id, x.at.replace(tzinfo=UTC)) for x in run_available(spark, orphans(stream, 24 * HOUR), "append").collect()}
    assert got == {("a", f"i{n}", T0 + n * HOUR) for n in (0, 3, 5, 6)} | {("b", "i3", T0)}  # i4 is assigned in the batch in which it would be too old


def test_a_stream_without_keys_has_one_tenant(spark, tmp_path):
    rows = [[("c", T0, 1), ("c", T0 + HOUR, 2), ("d", T0 + 9 * HOUR, 3)]]
    stream = streamed(spark, tmp_path / "in", rows, "cluster_id string, ts timestamp, size int")
    got = run_available(spark, cluster_changes(stream, 3 * HOUR), "append").orderBy("at").select("stream_key", "cluster_id", "type", F.col("size")).collect()
    assert [tuple(x) for x in got] == [("", "c", "cluster.opened", 1), ("", "c", "cluster.closed", 2), ("", "d", "cluster.opened", 1)]


def test_keys_that_share_a_slot_keep_their_own_state(spark, tmp_path):
    rows = [[("a", f"c{n}", T0 + timedelta(minutes=n * (k + 1))) for n in range(300) for k in range(2)], [("a", "c7", T0 + 40 * HOUR), ("b", "c7", T0 + 41 * HOUR)], [("a", "c8", T0 + 43 * HOUR)]]
    stream = streamed(spark, tmp_path / "in", rows, "stream_key string, cluster_id string, ts timestamp")
    got = [(x.stream_key, x.cluster_id, x.type, x.at.replace(tzinfo=UTC), x.size) for x in run_available(spark, cluster_changes(stream, 20 * HOUR, slots=1), "append").collect()]
    assert sorted(got, key=str) == changes([r for b in rows for r in b], 20 * HOUR, T0 + 43 * HOUR) and len(got) > 600
