"""Webhooks posted by tasks to a server of this process."""

from __future__ import annotations

import json
import threading
from datetime import UTC, datetime, timedelta
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pyarrow as pa
import pytest

from driftclust.config import Config, Webhook
from driftclust.engine import ClusteringEngine, Item
from driftclust.events import Event
from driftclust.sinks.delivery import Delivery, Hook, bodies, hook_of, posting, signature

T0 = datetime(2024, 5, 1, 12, tzinfo=UTC)
EVENTS = "seq long, type string, ts timestamp, cluster_id string, item_id string, data string"


@pytest.fixture
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            with self.server.lock:
                self.server.got.append((json.loads(body), body, dict(self.headers)))
                status = self.server.answer(json.loads(body))
            self.send_response(status)
            self.send_header("Content-Length", "0")
            self.end_headers()

        def log_message(self, *args):
            pass

    s = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    s.got, s.lock, s.answer = [], threading.Lock(), lambda body: 204
    threading.Thread(target=s.serve_forever, daemon=True).start()
    s.url = f"http://127.0.0.1:{s.server_port}/in"
    yield s
    s.shutdown()


def events(spark, rows):
    return spark.createDataFrame([(seq, kind, T0 + timedelta(microseconds=seq % 2), c, i, d) for seq, kind, c, i, d in rows], EVENTS).repartition(3)


def test_events_reach_the_hook_once_in_order_of_each_cluster(spark, server, tmp_path):
    rows = [(n, "cluster.opened" if n % 3 else "item.assigned", f"c{n % 4}" if n % 5 else None, f'i"{n}' if n % 2 else None, '{"size":3,"text":"ü"}' if n % 2 else None) for n in range(1, 41)]
    d = Delivery(spark, Hook(server.url, ("cluster.opened",), "key"), str(tmp_path))
    assert d.run(events(spark, rows[:25])) == {"sent": sum(r[1] == "cluster.opened" for r in rows[:25])}
    assert d.run(events(spark, rows[:25])) == {} and d.done() == 25
    d.run(events(spark, rows))
    assert sorted(b["seq"] for b, *_ in server.got) == [r[0] for r in rows if r[1] == "cluster.opened"]
    for c in ("c0", "c1", "c2", "c3"):
        mine = [b["seq"] for b, *_ in server.got if b["cluster_id"] == c]
        assert mine == sorted(mine) and mine
    for body, raw, headers in server.got:
        seq, kind, cluster, item, data = rows[body["seq"] - 1]
        assert body == {"seq": seq, "type": kind, "ts": (T0 + timedelta(microseconds=seq % 2)).isoformat(), "cluster_id": cluster, "item_id": item, "data": json.loads(data or "{}")}
        assert headers["X-Signature"] == signature("key", raw) and headers["X-Event"] == kind
    assert d.outcomes().count() == len(server.got)


def test_refusals_and_silence(spark, server, tmp_path):
    server.answer = lambda body: {1: 404, 2: 429, 3: 503}.get(body["seq"], 200)
    out = posting(Hook(server.url, tries=3), wait=(waits := []).append)
    batch = bodies(events(spark, [(n, "cluster.closed", "c", None, "{}") for n in (1, 2, 3, 4)]).orderBy("seq")).select("seq", "type", "body").toArrow().combine_chunks().to_batches()[0]
    got = next(out(iter([batch]))).to_pydict()
    assert got == {"seq": [1, 2, 3, 4], "outcome": ["refused", "given up", "given up", "sent"], "attempts": [1, 3, 3, 1], "status": [404, 429, 503, 200]} and waits == [0.5, 1.0, 0.5, 1.0]
    silent = posting(Hook("http://127.0.0.1:9/", tries=2, seconds=1), wait=lambda s: None)
    assert next(silent(iter([batch.slice(0, 1)]))).to_pydict()["outcome"] == ["given up"]
    empty = pa.RecordBatch.from_pylist([], schema=batch.schema)
    assert next(out(iter([empty]))).num_rows == 0
    d = Delivery(spark, Hook(server.url), str(tmp_path))
    assert d.run(events(spark, []).where("false")) == {} and d.done() == 0


def test_hooks_are_checked(monkeypatch):
    for url in ("ftp://x", "x", ""):
        with pytest.raises(ValueError):
            Hook(url)
    with pytest.raises(ValueError):
        hook_of(Webhook("http://x", "NO_SUCH_SECRET"))
    monkeypatch.setenv("SOME_SECRET", "s")
    assert hook_of(Webhook("http://x", "SOME_SECRET", max_retries=2)) == Hook("http://x", None, "s", 3, 5.0)
    assert Hook("http://x").name != Hook("http://x", ("a",)).name


def test_an_engine_posts_what_it_commits(spark, server, tmp_path):
    config = Config(store=str(tmp_path / "state"), min_cluster_size=5, min_samples=3, threshold_bounds=(0.3, 0.95), webhooks=(Webhook(server.url, None, ("cluster.opened", "item.assigned")),))
    e = ClusteringEngine(spark, config)
    e.ingest([Item(f"a{i}", f"the tide came in over the grey sea wall {i % 3}", T0 + timedelta(minutes=i)) for i in range(12)])
    opened = e.discover().opened
    e.close()
    told = [Event.of(r) for r in e.store.snapshot().events().collect()]
    assert len(opened) == 1 and sorted(b["seq"] for b, *_ in server.got) == [x.seq for x in told if x.type in ("cluster.opened", "item.assigned")]
    for body, *_ in server.got:
        stored = next(x for x in told if x.seq == body["seq"])
        assert {k: v for k, v in body.items() if k != "ts"} == {"seq": stored.seq, "type": stored.type, "cluster_id": stored.cluster_id, "item_id": stored.item_id, "data": stored.data}
