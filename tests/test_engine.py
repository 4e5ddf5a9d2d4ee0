"""The engine's behaviour end to end."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from driftclust.clock import SimulatedClock
from driftclust.config import Config
from driftclust.engine import ClusteringEngine, Item, ModelMismatch
from driftclust.events import EventRoutes
from driftclust.functions.embed import HashingEmbedder
from driftclust.state.store import Conflict

T0 = datetime(2026, 3, 1, tzinfo=UTC)
TOPICS = {"sea": "harbor vessel tide anchor sailor reef captain lagoon".split(), "code": "compiler syntax runtime pointer thread kernel buffer socket".split()}
BASE = Config(embedder="hashing:256", min_cluster_size=5, min_samples=3, threshold_bounds=(0.3, 0.95), merge_threshold=0.8, close_after="1d", buffer_max_age="2d", discovery_min_buffer=20, exemplars_per_cluster=16)


def items(topic, n, minutes=0, seed=1):
    r = random.Random(f"{topic}{seed}")
    return [Item(f"{topic}-{seed}-{i}", " ".join(r.sample(TOPICS[topic], 5)), T0 + timedelta(minutes=10 * i + minutes)) for i in range(n)]


def engine(spark, hours=3, **values):
    return ClusteringEngine(spark, BASE.with_values(**values), clock=SimulatedClock(T0 + timedelta(hours=hours)))


@pytest.fixture(scope="module")
def two_topics(spark):
    e = engine(spark)
    e.ingest(items("sea", 12) + items("code", 12, 5))
    e.found = e.discover()
    return e


def test_first_items_wait_and_discovery_opens_a_cluster_for_each_topic(spark, two_topics):
    r = two_topics.found
    assert (r.snapshot_size, len(r.opened), r.noise, r.rejected) == (24, 2, 0, 0)
    sizes = [c.size for c in two_topics.clusters("open").collect()]
    assert sizes == [12, 12]
    assert two_topics.discover().skipped_reason == "buffer too small"
    kinds = [x.type for x in two_topics.events().collect()][:26]
    assert kinds == ["cluster.opened", *["item.assigned"] * 12] * 2
    seqs = [x.seq for x in two_topics.events().collect()]
    assert seqs == list(range(1, len(seqs) + 1))


def test_names_depend_on_members_only(spark, two_topics):
    e = engine(spark)
    e.ingest(items("code", 12, 5) + items("sea", 12))
    assert sorted(e.discover().opened) == sorted(two_topics.found.opened)


def test_matches_duplicates_and_runner_up(spark, two_topics):
    before = {c.id: c.size for c in two_topics.clusters().collect()}
    batch = items("sea", 6, 200, 2)
    r = two_topics.ingest([*batch, batch[0], items("code", 1)[0]]).collect()
    assert [x.item_id for x in r] == [i.id for i in batch] + [batch[0].id, "code-1-0"]
    assert [x.duplicate for x in r] == [False] * 6 + [True, True]
    assert all(x.runner_up_cluster_id and x.runner_up_score < x.score for x in r[:6])
    after = {c.id: c.size for c in two_topics.clusters().collect()}
    assert sum(after.values()) - sum(before.values()) == sum(x.cluster_id is not None for x in r[:6])
    again = two_topics.ingest(batch).collect()
    assert all(x.duplicate for x in again) and two_topics.clusters().agg(F.sum("size")).first()[0] == sum(after.values())
    assert two_topics.store.snapshot().table("exemplars").groupBy("cluster_id").count().agg(F.max("count")).first()[0] <= 16


@pytest.mark.parametrize("bad,error", [([Item(" ", "x", T0)], ValueError), ([Item("a", "  ", T0)], ValueError), ([Item("a", "x", "2026")], TypeError), (["x"], TypeError)])
def test_bad_items_are_refused(spark, two_topics, bad, error):
    with pytest.raises(error):
        two_topics.ingest(bad)


def test_other_models_are_refused(spark, two_topics):
    with pytest.raises(ModelMismatch):
        ClusteringEngine(spark, BASE.with_values(embedder="hashing:64"), store=two_topics.store)


def test_lifecycle(spark):
    told = []
    e = engine(spark, reopen_grace="1d")
    e.bus.route(lambda event: told.append(event.type), "cluster.closed", "cluster.reopened", "cluster.archived", "item.orphaned")
    e.ingest([*items("sea", 12), Item("odd", "zz qq unlike anything", T0)])
    (cid,) = e.discover().opened
    assert e.sweep() == ((), (), (), 0, ())
    e.clock.advance_to(T0 + timedelta(days=1, hours=3))
    assert e.sweep().closed == (cid,)
    assert e.sweep() == ((), (), (), 0, ()), "a sweep again changes nothing"
    r = e.ingest(items("sea", 3, 60 * 27, 5)).collect()
    assert any(x.cluster_id == cid for x in r) and e.get_cluster(cid)["status"] == "open" and e.get_cluster(cid)["closed_at"] is None
    e.clock.advance_to(T0 + timedelta(days=4))
    s = e.sweep()
    assert s.closed == (cid,) and s.orphaned >= 1
    e.clock.advance_to(T0 + timedelta(days=5, seconds=1))
    assert e.sweep().archived == (cid,)
    assert told.count("cluster.closed") == 2 and told.count("cluster.reopened") == 1 and told.count("cluster.archived") == 1
    assert all(x.cluster_id is None for x in e.ingest(items("sea", 2, 60 * 120, 6)).collect())


def test_alike_clusters_merge_in_a_sweep(spark):
    e = engine(spark, merge_threshold=0.99)
    e.ingest(items("sea", 12))
    (a,) = e.discover().opened
    b = e.split_cluster(a, [f"sea-1-{i}" for i in range(5)])
    assert e.store.snapshot().table("no_merge").count() == 1
    loose = ClusteringEngine(spark, BASE.with_values(merge_threshold=0.3), store=e.store, clock=e.clock)
    assert loose.sweep().merged == (), "what was split stays apart"
    loose.reopen_cluster(a), loose.unlock_cluster(a)
    t = e.store.transaction()
    t.replace("no_merge", t.table("no_merge").where("false"))
    t.commit()
    assert loose.sweep().merged == ((b, a),)
    assert loose.resolve(b) == a and loose.get_cluster(b)["size"] == 0 and loose.get_cluster(a)["size"] == 12


def test_overrides(spark):
    e = engine(spark)
    e.ingest(items("sea", 12) + items("code", 12, 5))
    a, b = e.discover().opened
    e.move_item("code-1-0", a)
    assert (e.get_cluster(a)["size"], e.get_cluster(b)["size"]) == (13, 11)
    assert e.members(a).where("item_id = 'code-1-0'").first().locked
    with pytest.raises(KeyError):
        e.move_item("nobody", a)
    with pytest.raises(KeyError):
        e.close_cluster("cl_none")
    with pytest.raises(ValueError):
        e.merge_clusters(a, a)
    with pytest.raises(ValueError):
        e.split_cluster(a, ["code-1-1"])
    with pytest.raises(ValueError):
        e.split_cluster(b, [f"code-1-{i}" for i in range(1, 12)])
    e.close_cluster(b)
    assert e.get_cluster(b)["status_locked"] and all(x.cluster_id is None for x in e.ingest(items("code", 3, 300, 9)).collect())
    assert e.merge_clusters(a, b, survivor=b) == b
    assert e.get_cluster(b)["status"] == "open" and e.get_cluster(b)["size"] == 24
    with pytest.raises(ValueError):
        e.close_cluster(a)


def test_loose_groups_are_rejected(spark):
    e = engine(spark, threshold_bounds=(0.99, 0.995))
    e.ingest(items("sea", 12) + items("code", 12, 5))
    r = e.discover()
    assert r.opened == () and r.rejected == 2 and e.buffer_size() == 24


def test_overlapping_groups_fold(spark):
    e = engine(spark, merge_threshold=0.3, threshold_bounds=(0.94, 0.95))
    e = ClusteringEngine(spark, BASE.with_values(merge_threshold=0.3), clock=SimulatedClock(T0 + timedelta(hours=3)))
    e.ingest(items("sea", 12))
    (a,) = e.discover().opened
    strict = ClusteringEngine(spark, BASE.with_values(merge_threshold=0.3), store=e.store, clock=e.clock)
    t = e.store.transaction()
    t.replace("clusters", t.table("clusters").withColumn("threshold", F.lit(0.999)))
    t.commit()
    strict.ingest(items("sea", 8, 200, 4))
    r = strict.discover()
    assert r.opened == () and set(r.folded) == {a} and strict.get_cluster(a)["size"] == 20


def test_reembed(spark):
    e = engine(spark)
    e.ingest(items("sea", 12))
    (a,) = e.discover().opened
    assert e.reembed(HashingEmbedder(64)) == 12
    s = e.store.snapshot()
    assert s.meta("model_id") == "hashing:64" and {len(r.embedding) for r in s.vectors().collect()} == {64} == {len(r.embedding) for r in s.table("exemplars").collect()}
    assert any(x.cluster_id == a for x in e.ingest(items("sea", 4, 200, 3)).collect())


def test_detail_and_samples(spark, two_topics):
    c = two_topics.found.opened[0]
    d = two_topics.cluster_detail(c, 5)
    assert d.counts_over_time.agg(F.sum("n")).first()[0] == two_topics.get_cluster(c)["size"]
    for strategy in ("central", "random", "recent", "mixed"):
        rows = two_topics.sample(c, 5, strategy).collect()
        assert len({r.item_id for r in rows}) == 5 and [r["rank"] for r in rows] == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        two_topics.sample(c, 5, "best")
    assert two_topics.stats()["clusters"]["open"] == 2


def test_a_commit_that_is_overtaken_leaves_nothing(spark):
    e = engine(spark)
    t, u = e.store.transaction(), e.store.transaction()
    t.set_meta("a", "1")
    t.commit()
    u.append("no_merge", spark.createDataFrame([("a", "b")], "a string, b string"))
    with pytest.raises(Conflict):
        u.commit()
    assert e.store.snapshot().table("no_merge").count() == 0 and e.store.snapshot().meta("a") == "1"


def test_locks(spark):
    s = engine(spark).store
    ttl = timedelta(seconds=60)
    assert s.acquire_lock("x", "me", T0, ttl) and s.acquire_lock("x", "me", T0, ttl)
    assert not s.acquire_lock("x", "you", T0, ttl)
    assert s.acquire_lock("x", "you", T0 + timedelta(seconds=61), ttl)
    s.release_lock("x", "me")
    assert not s.acquire_lock("x", "me", T0 + timedelta(seconds=61), ttl)


def test_failing_sinks_and_labelers_stop_nothing(spark):
    bus = EventRoutes()
    bus.route(lambda event: 1 / 0)

    def broken(texts, targets):
        raise RuntimeError("no labels today")

    e = ClusteringEngine(spark, BASE, clock=SimulatedClock(T0), bus=bus, labeler=broken)
    e.ingest(items("sea", 12))
    (a,) = e.discover().opened
    assert e.get_cluster(a)["label"] is None


def test_the_index_is_kept_while_it_holds(spark):
    e = engine(spark)
    e.ingest(items("sea", 12) + items("code", 12, 5))
    e.discover()
    batch = items("sea", 4, 400, 5)
    found = {r.item_id: (r.cluster_id, r.score) for r in e.match(batch).collect()}
    index, size = e._index, e.buffer_size()
    assert e.match(batch).count() == 4 and e._index is index and e.buffer_size() == size
    placed = {r.item_id: (r.cluster_id, r.score) for r in e.ingest(batch).collect()}
    assert placed == found and any(c for c, _ in placed.values())
    e.match(batch).collect()
    assert e._index is not index, "the batch moved clusters"
    e.clock.advance_to(T0 + timedelta(days=2))
    assert len(e.sweep().closed) == 2
    e.match(batch).collect()
    index = e._index
    assert index.until == T0 + timedelta(days=2) + e.config.grace
    e.clock.advance_to(index.until + timedelta(seconds=1))
    assert {r.cluster_id for r in e.match(batch).collect()} == {None} and e._index is not index
