"""Several writers on one state, and what they leave behind."""

from __future__ import annotations

import threading
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from driftclust.clock import SimulatedClock
from driftclust.engine import ClusteringEngine
from driftclust.operators import discover as D
from driftclust.operators import lifecycle as L
from driftclust.schema import CLUSTERS
from driftclust.state.files import Files
from driftclust.state.store import Conflict, StateStore
from tests.test_engine import BASE, T0, engine, items


def test_another_writer_may_commit_while_a_job_runs(spark, monkeypatch):
    a = engine(spark)
    a.ingest(items("sea", 12) + items("code", 12, 5))
    b = ClusteringEngine(spark, a.config, store=StateStore(spark, a.store.path), clock=SimulatedClock(T0 + timedelta(hours=3)))
    groups, stale = D.groups, L.stale

    def meanwhile(job, other):
        done = []

        def run(*args):
            found = job(*args)
            if not done:
                done.append(other())
            return found

        return run

    monkeypatch.setattr(D, "groups", meanwhile(groups, lambda: b.ingest(items("sea", 3, 130, 7)).count()))
    report = a.discover()
    assert len(report.opened) == 2 and a.stats()["items"]["assigned"] + a.buffer_size() == 27
    late = [x.id for x in items("sea", 3, 130, 7)]
    assert {r.id for r in a.store.snapshot().places().where("status = 'assigned'").collect()} & set(late), "items that came meanwhile are matched to what was found"
    a.clock.advance_to(T0 + timedelta(days=5))
    monkeypatch.setattr(L, "stale", meanwhile(stale, lambda: b.ingest(items("code", 2, 140, 8)).count()))
    assert len(a.sweep().closed) == 2
    assert sum(a.stats()["items"].values()) == 29
    seqs = [e.seq for e in a.events().collect()]
    assert seqs == list(range(1, len(seqs) + 1))


def test_one_of_many_publishes_a_name(spark, tmp_path, monkeypatch):
    files = Files(spark, f"file://{tmp_path}/s")
    won: list[int] = []

    def go(i):
        if files.publish("_manifest/1.json", str(i)):
            won.append(i)

    threads = [threading.Thread(target=go, args=(i,)) for i in range(8)]
    [t.start() for t in threads], [t.join() for t in threads]
    assert len(won) == 1 and files.read("_manifest/1.json") == str(won[0]) and files.names("_new") == []
    files.create("draft", "x")
    files._rename_new("draft", "named")
    files.create("draft", "y")
    with pytest.raises(Exception, match="AlreadyExists|already exists"):
        files._rename_new("draft", "named")
    assert files.read("named") == "x"


def test_locks_have_turns(spark, tmp_path):
    store = StateStore(spark, f"file://{tmp_path}/s")
    ttl = timedelta(minutes=1)
    assert store.acquire_lock("x", "a", T0, ttl) and not store.acquire_lock("x", "b", T0, ttl)
    turn, _ = store._lock_state("x")
    late = T0 + timedelta(minutes=2)
    assert [store._next_turn("x", turn, o, late.timestamp() + 60) for o in "bc"] == [True, False], "two that saw the lock expire"
    assert not store.acquire_lock("x", "c", late, ttl) and store.acquire_lock("x", "b", late, ttl)
    store.release_lock("x", "a")
    assert not store.acquire_lock("x", "c", late, ttl)
    store.release_lock("x", "b")
    assert store.acquire_lock("x", "c", late, ttl)


def test_what_jobs_leave_is_swept(spark):
    e = engine(spark)
    e.ingest(items("sea", 4))
    txn, late = e.store.transaction(), e.store.transaction()
    txn.append("no_merge", spark.createDataFrame([("a", "b")], "a string, b string"))
    late.append("no_merge", spark.createDataFrame([("c", "d")], "a string, b string"))
    txn.commit()
    with pytest.raises(Conflict):
        late.commit()
    assert e.store.files.names("_stage") == [] and len(e.store.files.names("no_merge")) == 2
    assert e.store.vacuum() == 0
    assert e.store.vacuum(timedelta(seconds=-5)) > 0
    assert len(e.store.files.names("no_merge")) == 1 and e.store.files.names("_manifest") == [f"{e.store.version():012d}.json"]
    assert e.buffer_size() == 4 and e.ingest(items("sea", 5)).where("duplicate").count() == 4


def test_a_commit_needs_a_known_store(spark):
    with pytest.raises(ValueError):
        ClusteringEngine(spark, BASE.with_values(store="sqlite:///x"))


def test_clusters_are_added_once_and_updated_if_they_are_there(spark):
    e = engine(spark)
    row = lambda name, size: (name, "open", 0.5, size, T0, T0, T0, None, None, None, False, size, size)
    rows = lambda *some: spark.createDataFrame(list(some), CLUSTERS)
    txn = e.store.transaction()
    txn.add_clusters(rows(row("a", 1), row("b", 2)))
    for bad in (rows(row("b", 3)), rows(row("c", 1), row("c", 1))):
        with pytest.raises(ValueError):
            txn.add_clusters(bad)
    with pytest.raises(KeyError):
        txn.update_clusters(rows(row("a", 5), row("z", 1)))
    assert {(r.id, r["size"]) for r in txn.table("clusters").collect()} == {("a", 1), ("b", 2)}
    txn.update_clusters(txn.table("clusters").where("id = 'b'").withColumn("size", F.lit(9)))
    txn.commit()
    assert {(r.id, r["size"]) for r in e.clusters().collect()} == {("a", 1), ("b", 9)}
