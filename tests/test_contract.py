"""The driver's contract, streams, replay and the façades."""

from __future__ import annotations

import json
import math
import os
from collections import Counter
from datetime import datetime, timedelta
from decimal import Decimal

import numpy as np
import pytest

import __spark_entry__ as entry
from driftclust.cli import main
from driftclust.config import Config
from driftclust.evaluation import runner
from driftclust.operators import discover as D
from driftclust.plans.catalogue import QUERIES
from driftclust.plans.oracles import ORACLES
from driftclust.service import Service, Throttle
from driftclust.sources.synthetic import stream
from driftclust.streaming.ingest import ingest_stream
from tests.test_engine import BASE, engine, items

DATA = "/root/testdata/sf0.001"


def test_contract(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and set(ORACLES) <= set(QUERIES) and set(QUERIES) - set(ORACLES) == {"q26_embed_hashing", "q51_discover_groups", "q60_nearest_recall"}
    assert entry.entry(spark).count() == 500


def canon(value):
    """Values of either engine as the comparison takes them: floats to 6 digits without negative zero, times without zone."""
    if isinstance(value, (float, Decimal)):
        return None if math.isnan(value) else round(float(value), 6) + 0.0
    if isinstance(value, datetime):
        return value.replace(tzinfo=None)
    return tuple(map(canon, value)) if isinstance(value, (list, tuple)) else value


def same_rows(got, columns, rows) -> bool:
    names = sorted(got.columns)
    mine = Counter(tuple(canon(r[c]) for c in names) for r in got.collect())
    return names == sorted(columns) and mine == Counter(tuple(canon(r[columns.index(c)]) for c in names) for r in rows)


@pytest.fixture(scope="module")
def tables():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for file in os.listdir(DATA):
        c.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_match_sql(spark, tables, name):
    found = tables.execute(ORACLES[name])
    columns = [x[0] for x in found.description]
    assert same_rows(QUERIES[name](spark, DATA), columns, found.fetchall())


def test_density_groups_count_vectors_beyond_the_fit(spark, monkeypatch):
    from driftclust.plans import catalogue

    whole = {r.label: r.n for r in QUERIES["q51_discover_groups"](spark, DATA).collect()}
    monkeypatch.setattr(catalogue, "FIT", 300)
    found = {r.label: r.n for r in QUERIES["q51_discover_groups"](spark, DATA).collect()}
    assert sum(found.values()) == sum(whole.values()) == spark.read.parquet(f"{DATA}/embeddings.parquet").count() > 300
    fitted = D.groups(D.fit_sample(spark.read.parquet(f"{DATA}/embeddings.parquet").selectExpr("cast(vec_id as string) id", "vec_id seq", "embedding"), 300, catalogue.SEED), 5, 3, 5)
    fitted = {r.label: r["count"] for r in fitted.groupBy("label").count().collect()}
    assert set(found) <= {*fitted, -1} and all(found[k] >= n for k, n in fitted.items())
    assert sum(found[k] for k in found if k >= 0) > sum(n for k, n in fitted.items() if k >= 0)


def test_the_rest_stands_without_the_text_operators(tmp_path):
    import os
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(root, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert not any(k.startswith('op') or k == 'pipeline' for k in q); assert len(q) > 40"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env={**os.environ, "PYTHONPATH": ""}, check=True, timeout=120)


def test_streamed_items_are_ingested_once(spark, tmp_path):
    e = engine(spark)
    rows = [(i.id, i.text, i.timestamp, {"k": "v"}) for i in items("sea", 12)]
    schema = "id string, text string, ts timestamp, metadata map<string,string>"
    for k in range(2):
        spark.createDataFrame(rows[6 * k : 6 * k + 8], schema).write.mode("append").parquet(str(tmp_path / "in"))
    for _ in range(2):
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        ingest_stream(e, source, str(tmp_path / "check")).awaitTermination()
    assert e.buffer_size() == 12 and len(e.discover().opened) == 1
    s = e.store.snapshot().table("items").orderBy("seq").collect()
    assert [r.seq for r in s] == list(range(1, 13)) and s[0].metadata == {"k": "v"}


def test_replay_is_deterministic_and_measured(spark):
    config = BASE.with_values(close_after="1d", discovery_interval="12h", sweep_interval="12h", discovery_min_buffer=20)
    data = stream(spark, topics=3, per_topic=30, noise=4, days=4)
    how = {"window": timedelta(hours=12), "most": 500}
    a, b = (runner.run_eval(spark, data, config, **how) for _ in range(2))
    log = lambda r: [(x.type, x.ts, x.cluster_id, x.item_id, x.data) for x in r.engine.events().collect()]
    assert log(a) == log(b) and len(log(a)) > 20
    assert a.metrics["topics_detected"] >= 2 and a.metrics["precision"] >= 0.9 and a.metrics["items"] == 94
    with pytest.raises(ValueError):
        runner.run_eval(spark, data.drop("label").selectExpr("*", "cast(null as string) as label"), config)


def test_front_of_trials():
    t = [runner.Trial({"a": i}, {"false_merge_rate": x, "fragmentation": y}) for i, (x, y) in enumerate([(0.1, 2), (0.2, 1), (0.2, 2), (0.1, 2)])]
    assert {x.params["a"]: x.pareto for x in runner.mark_front(t)} == {0: True, 1: True, 2: False, 3: True}
    assert len(runner.default_grid(Config())["threshold_bounds"]) == 3


def test_service(spark):
    s = Service(engine(spark), api_key="k", per_minute=600)
    key = {"x-api-key": "k"}
    assert s.handle("GET", "/health")[0] == 200 and s.handle("GET", "/stats")[0] == 401
    body = {"items": [{"id": i.id, "text": i.text, "timestamp": i.timestamp.isoformat()} for i in items("sea", 12)]}
    code, out = s.handle("POST", "/items", json.dumps(body).encode(), key)
    assert code == 200 and len(out["data"]) == 12
    cid = s.handle("POST", "/discover", b"", key)[1]["data"]["opened"][0]
    assert s.handle("GET", "/clusters?status=open", b"", key)[1]["data"][0]["id"] == cid
    assert len(s.handle("GET", f"/clusters/{cid}/sample?n=3", b"", key)[1]["data"]) == 3
    assert s.handle("GET", "/clusters/none", b"", key)[0] == 404 and s.handle("GET", "/events?limit=0", b"", key)[0] == 400
    assert s.handle("POST", "/items", b"[]", key)[0] == 400 and s.handle("GET", "/nowhere", b"", key)[0] == 404
    now = [0.0]
    r = Throttle(2, clock=lambda: now[0])
    assert [r.admit("a"), r.admit("a"), r.admit("a"), r.admit("b")] == [True, True, False, True]
    now[0] = 31
    assert r.admit("a")


def test_command_line(spark, tmp_path, capsys):
    f = tmp_path / "in.csv"
    f.write_text("id,text,timestamp\n" + "".join(f"{i.id},{i.text},{i.timestamp.isoformat()}\n" for i in items("sea", 12)))
    (tmp_path / "c.yaml").write_text("min_cluster_size: 5\nmin_samples: 3\nthreshold_bounds: [0.3, 0.95]\n")
    base = ["-c", str(tmp_path / "c.yaml"), "--store", str(tmp_path / "state"), "--json"]
    run = lambda *a: (main([*base, *a], spark), capsys.readouterr())
    code, out = run("ingest", str(f), "--discover")
    assert code == 0 and json.loads(out.out)["buffered"] == 12
    code, out = run("clusters")
    cid = json.loads(out.out)[0]["id"]
    assert run("show", cid)[0] == 0 and run("close", "cl_x")[0] == 1
    assert run("report", str(tmp_path / "r.html"))[0] == 0 and "<svg" in (tmp_path / "r.html").read_text()


def test_core_distances_of_a_fit_are_made_in_several_tasks(spark, monkeypatch):
    from driftclust.operators.density import core_distances, density_labels, reduce

    monkeypatch.setattr(D, "CORE_ROWS", 512)
    items = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").selectExpr("cast(vec_id as string) id", "vec_id seq", "embedding")
    rows = items.orderBy("seq").collect()
    x = reduce(np.array([r.embedding for r in rows], np.float32), 5)
    assert len(x) > 512
    whole = core_distances(x.astype(np.float64), 3)
    assert np.array_equal(np.concatenate([core_distances(x.astype(np.float64), 3, first=a, last=a + 512) for a in range(0, len(x), 512)]), whole)
    found = D.groups(items, 5, 3, 5)
    assert "MapInArrow" in found._jdf.queryExecution().toString()
    assert {r.id: r.label for r in found.collect()} == {r.id: n for r, n in zip(rows, density_labels(x, 5, 3).tolist(), strict=True)}
