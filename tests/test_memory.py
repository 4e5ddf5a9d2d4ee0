"""Vectors by content: what is embedded, and how often."""

from __future__ import annotations

import os
import uuid
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from driftclust.config import Config
from driftclust.engine import ClusteringEngine, Item
from driftclust.evaluation import runner
from driftclust.functions import memory as M
from driftclust.functions.embed import HashingEmbedder

T0 = datetime(2024, 3, 1, tzinfo=UTC)


class Counting:
    """Writes each text that it embeds to a file of its own."""

    def __init__(self, folder, model_id="counting:32"):
        self.folder, self.model_id = str(folder), model_id

    def embed(self, texts):
        with open(os.path.join(self.folder, uuid.uuid4().hex), "w") as f:
            f.write("\x00".join([*texts, ""]))
        return HashingEmbedder(32).embed(texts)

    def seen(self):
        out = []
        for name in os.listdir(self.folder):
            with open(os.path.join(self.folder, name)) as f:
                out += f.read().split("\x00")[:-1]
        return sorted(out)


@pytest.fixture
def counting(tmp_path):
    (tmp_path / "seen").mkdir()
    return Counting(tmp_path / "seen")


def test_each_distinct_text_is_embedded_once(spark, tmp_path, counting):
    texts = ["sea", "sea", "tide", None, "", "Ü wall", "sea"] + [f"t{i % 7}" for i in range(40)]
    rows = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "id long, text string, key long").repartition(4)
    m = M.VectorMemory(spark, str(tmp_path / "memory"), counting)
    got = {r.id: r for r in m.embed(rows).collect()}
    assert len(got) == len(texts) and all(r.key == 1 for r in got.values())
    plain = HashingEmbedder(32).embed([t or "" for t in texts])
    assert all(np.allclose(got[i].embedding, plain[i]) for i in got)
    assert counting.seen() == sorted({t or "" for t in texts})
    more = spark.createDataFrame([(0, "tide"), (1, "new")], "id long, text string")
    assert m.embed(more).count() == 2 and counting.seen() == sorted({t or "" for t in texts} | {"new"})
    other = M.VectorMemory(spark, str(tmp_path / "memory"), Counting(counting.folder, "another"))
    assert other.table().count() == 0 and m.table().count() == 12
    assert m.embed(rows.where("false")).count() == 0


def test_filters_hold_their_keys_and_few_others(spark):
    keys = lambda a, b: spark.range(a, b).select(M.text_key(__import__("pyspark").sql.functions.col("id").cast("string")).alias("key"))
    f = M.KeyFilter.of(keys(0, 3000).repartition(5))
    assert f.keep(keys(0, 3000)).count() == 3000 and f.keep(keys(10_000, 20_000)).count() < 200
    assert M.KeyFilter.of(keys(0, 0)).keep(keys(0, 100)).count() == 0


def test_an_engine_with_a_memory_embeds_no_text_twice(spark, tmp_path, counting):
    config = Config(store=str(tmp_path / "state"), vector_memory=str(tmp_path / "memory"), min_cluster_size=5, min_samples=3, threshold_bounds=(0.3, 0.95))
    e = ClusteringEngine(spark, config, embedder=counting)
    items = [Item(f"a{i}", f"the tide came in over the wall {i % 4}", T0 + timedelta(minutes=i)) for i in range(12)]
    assert e.match(items[:3]).count() == 3
    e.ingest(items[:6]), e.ingest(items)
    again = ClusteringEngine(spark, config.with_values(store=str(tmp_path / "replayed")), embedder=counting)
    again.ingest(items)
    assert counting.seen() == sorted({i.text for i in items})
    other = Counting(counting.folder, "counting:other")
    e.reembed(other), again.reembed(Counting(counting.folder, "counting:other"))
    assert counting.seen() == sorted([*{i.text for i in items}] * 2)
    assert e.store.snapshot().vectors().count() == 12


def test_tuning_embeds_once(spark, monkeypatch):
    runs = []
    whole = M.VectorMemory.embed
    monkeypatch.setattr(M.VectorMemory, "embed", lambda self, rows, *a, **b: (runs.append(self.table().count()), whole(self, rows, *a, **b))[1])
    items = spark.createDataFrame([(f"i{i}", f"the {['tide', 'bread'][i % 2]} is {['in over the wall', 'in the warm oven'][i % 2]} {i % 5}", T0 + timedelta(minutes=i), ["sea", "bread"][i % 2]) for i in range(40)], "id string, text string, ts timestamp, label string")
    config = Config(min_cluster_size=5, min_samples=3, threshold_bounds=(0.3, 0.95), close_after="1d", discovery_interval="12h", sweep_interval="12h", discovery_min_buffer=10)
    trials = runner.tune(spark, items, config, {"merge_threshold": [0.8, 0.9]}, window=timedelta(hours=12), most=500)
    assert len(trials) == 2 and runs[0] == 0 and len(runs) > 2 and set(runs[1:]) == {10}
