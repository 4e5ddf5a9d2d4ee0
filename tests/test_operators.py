"""Operators and functions against plain Python."""

from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import numpy as np
import pytest

from driftclust.config import Config, format_duration, load_config, parse_duration
from driftclust.events import Event, describe
from driftclust.functions.embed import HashingEmbedder, make_embedder, unit_rows
from driftclust.operators import assign, scoring, timeline
from driftclust.operators.density import density_labels, reduce
from driftclust.sources.files import InputError, read_items
from driftclust.sources.synthetic import generate

T0 = datetime(2026, 3, 1, tzinfo=UTC)


def unit(n, dim=16, seed=0):
    return unit_rows(np.random.default_rng(seed).normal(size=(n, dim)))


def top_mean(v, exemplars, k):
    return float(np.sort(exemplars.astype(float) @ v.astype(float))[::-1][:k].mean())


def test_assign_is_the_naive_decision(spark, monkeypatch):
    sets = {f"c{i}": unit(n, seed=i) for i, n in enumerate((3, 8, 5, 1))}
    items = unit(300, seed=99)
    ex = spark.createDataFrame([(c, p, f"{c}-{p}", v.tolist()) for c, vs in sets.items() for p, v in enumerate(vs)], "cluster_id string, pos int, item_id string, embedding array<float>")
    live = spark.createDataFrame([(c, 0.2, 10 - i) for i, c in enumerate(sets)], "id string, threshold double, n int").selectExpr("id", "threshold", "timestamp_seconds(n) as opened_at")
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(items)], "item_id string, embedding array<float>").repartition(3)
    for limit in (1 << 20, 300):  # one block, then many
        monkeypatch.setattr(assign, "INDEX_BYTES", limit)
        got = {r.item_id: r for r in assign.assign(df, ex, live, 3).collect()}
        for i, v in enumerate(items):
            ranked = sorted(((top_mean(v, vs, 3), c) for c, vs in sets.items()), reverse=True)
            r = got[str(i)]
            assert r.score == pytest.approx(ranked[0][0], abs=1e-5) and r.runner_up_cluster_id == ranked[1][1]
            assert r.cluster_id == (ranked[0][1] if ranked[0][0] >= 0.2 else None)
    assert all(r.score is None and r.cluster_id is None for r in assign.assign(df, ex.where("false"), live, 3).collect())


def test_member_scores_leave_the_member_out(spark):
    vs = unit(12, seed=3)
    m = spark.createDataFrame([("a", str(i), v.tolist()) for i, v in enumerate(vs)] + [("lone", "x", vs[0].tolist())], "cluster_id string, item_id string, embedding array<float>")
    ex = scoring.draw_exemplars(m, 4, 1)
    chosen = {r.item_id: np.array(r.embedding) for r in ex.where("cluster_id = 'a'").collect()}
    assert len(chosen) == 4
    got = {r.item_id: r.score for r in scoring.member_scores(m, ex, 5).collect()}
    for i, v in enumerate(vs):
        others = np.stack([e for k, e in chosen.items() if k != str(i)])
        assert got[str(i)] == pytest.approx(top_mean(v, others, 3), abs=1e-6)
    assert got["x"] == 0.0


def test_draws_merge(spark):
    m = spark.createDataFrame([("a", f"i{i}", [float(i)]) for i in range(50)], "cluster_id string, item_id string, embedding array<float>")
    part, rest = m.where("item_id < 'i3'"), m.where("item_id >= 'i3'")
    ids = lambda d: sorted(r.item_id for r in d.collect())
    both = scoring.draw_exemplars(scoring.draw_exemplars(part, 8, 5).select(*m.columns).unionAll(rest), 8, 5)
    assert ids(both) == ids(scoring.draw_exemplars(m, 8, 5)) and len(ids(both)) == 8


def test_density_finds_groups_and_noise():
    r = np.random.default_rng(1)
    groups = [c + 0.05 * r.normal(size=(30, 8)) for c in 5 * np.eye(8)[:3]]
    noise = 20 * r.normal(size=(6, 8))
    labels = density_labels(np.concatenate([*groups, noise]).astype(np.float32), 5, 3)
    assert len({tuple(set(labels[30 * i : 30 * i + 30])) for i in range(3)}) == 3 and all(len(set(labels[30 * i : 30 * i + 30])) == 1 for i in range(3))
    assert (labels[90:] == -1).all()
    assert (density_labels(groups[0][:4], 5, 3) == -1).all()
    assert (density_labels(groups[0], 5, 3) >= -1).all() and (density_labels(groups[0], 10, 3) == 0).sum() >= 25


def test_reduction_keeps_small_samples():
    v = unit(40)
    assert reduce(v, 5) is v and reduce(unit(100, 64), 5).shape == (100, 15)


def test_embedder():
    e = make_embedder("hashing:64")
    a, b = e.embed(["Hello world again", "Hello world again"])
    assert np.allclose(a, b) and np.linalg.norm(a) == pytest.approx(1, abs=1e-6)
    assert not HashingEmbedder(8).embed([""]).any()
    with pytest.raises(ValueError):
        make_embedder("nothing:x")


@pytest.mark.parametrize("text,seconds", [("7d", 604800), ("1h30m", 5400), ("2w", 1209600), ("90s", 90), ("P1DT2H", 93600), (45, 45), ("45", 45), ("pt1.5h", 5400), ("1w 2d", 777600)])
def test_durations(text, seconds):
    assert parse_duration(text) == timedelta(seconds=seconds)


def test_config(tmp_path, monkeypatch):
    assert format_duration(timedelta(days=2)) == "2d" and format_duration(timedelta(seconds=90)) == "90s"
    f = tmp_path / "c.yaml"
    f.write_text("close_after: 3d\nmatch_top_k: 4\nthreshold_bounds: 0.6 to 0.8\n")
    monkeypatch.setenv("DRIFTCLUST_MATCH_TOP_K", "7")
    c = load_config(str(f), min_samples=2)
    assert (c.close_after, c.match_top_k, c.min_samples, c.threshold_bounds, c.grace) == (timedelta(days=3), 7, 2, (0.6, 0.8), timedelta(days=6))
    f.write_text("close_afterr: 3d\n")
    with pytest.raises(ValueError):
        load_config(str(f))
    with pytest.raises(ValueError):
        Config(threshold_bounds=(0.9, 0.5))
    for text in ("soon", "", "P", "1h P", "P1H", "PT1D", "1h30", "5y", True):
        with pytest.raises(ValueError):
            parse_duration(text)
    for bad in ({"min_cluster_size": 1}, {"merge_threshold": 0}, {"relabel_growth": 1.0}, {"umap_neighbors": 1}, {"label_terms": 0}, {"match_top_k": 2.5}, {"close_after": "0s"}, {"preprocess": {"max_chars": 0}}, {"exemplar_index": "x"}):
        with pytest.raises(ValueError):
            Config(**bad)


def test_greedy_batches(spark):
    from driftclust.streaming.replay import cut_batches

    times = [T0 + timedelta(minutes=m) for m in (0, 1, 4, 5, 6, 20, 21, 22, 23)]
    assert [(b.first, b.last) for b in cut_batches(enumerate(times), timedelta(minutes=5), 3)] == [(0, 2), (3, 4), (5, 7), (8, 8)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(times)], "event_id long, ts timestamp").repartition(3)
    rows = timeline.batch_numbers(df, timedelta(minutes=5), 3).orderBy("event_id").collect()
    assert [r.batch for r in rows] == [0, 0, 0, 1, 1, 2, 2, 2, 3]


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿key,body,when,topic,source\n1,"héllo, you",2026-03-01T00:00:00Z,sea,web\n2,two,1772323200,,\n', encoding="utf-8")
    from driftclust.config import Columns

    rows = read_items(spark, str(tmp_path / "a.csv"), Columns("key", "body", "when", "topic")).orderBy("id").collect()
    assert [(r.id, r.text, r.label, dict(r.metadata)) for r in rows] == [("1", "héllo, you", "sea", {"source": "web"}), ("2", "two", None, {})]
    assert rows[0].ts == rows[1].ts == datetime(2026, 3, 1)
    (tmp_path / "b.jsonl").write_text('{"id": 7, "text": "x", "timestamp": "2026-03-01", "extra": 1}\n\n')
    (r,) = read_items(spark, str(tmp_path / "b.jsonl")).collect()
    assert (r.id, r.label, dict(r.metadata)) == ("7", None, {"extra": "1"})
    for name, text in (("c.jsonl", "[1]\n"), ("d.jsonl", "{oops\n"), ("e.csv", "id,text\n1,x\n"), ("f.csv", "id,text,timestamp\n1, ,2026-01-01\n"), ("g.csv", "id,text,timestamp\n1,x,soon\n"), ("h.txt", "x")):
        (tmp_path / name).write_text(text)
        with pytest.raises(InputError):
            read_items(spark, str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        read_items(spark, str(tmp_path / "none.csv"))


def test_descriptions():
    e = Event(1, "cluster.opened", T0, "c", None, {"size": 3})
    assert "c" in describe(e) and describe(Event(3, "cluster.merged", T0, "a", None, {"survivor": "b", "similarity": None}))


def test_generator_is_seeded():
    assert generate(per_topic=5) == generate(per_topic=5) and len(generate(per_topic=5)) == 110
    assert random.Random(1).random() == random.Random(1).random()


def test_nearest_exemplars_in_parts(spark, monkeypatch):
    vs = unit(40, seed=5)
    ex = spark.createDataFrame([(f"c{i % 4}", i // 4, str(i), v.tolist()) for i, v in enumerate(vs)], "cluster_id string, pos int, item_id string, embedding array<float>")
    df = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(unit(20, seed=6))], "item_id string, embedding array<float>")
    rows = lambda: sorted((r.item_id, r.cluster_id, round(r.score, 9)) for r in scoring.nearest_exemplars(df, ex, 7, 3).collect())
    whole = rows()
    monkeypatch.setattr(scoring, "BLOCK_BYTES", 900)
    assert rows() == whole and len(whole) >= 20


def test_titles(spark):
    from driftclust.functions.titles import clean, title_labeler

    asked = []

    def complete(text):
        asked.append(text)
        if "pirate" in text:
            raise OSError("no line")
        return '\n"The Tide Turns."\nmore'

    texts = spark.createDataFrame([("a", i, f"tide harbor reef {i}") for i in range(20)] + [("b", i, f"pirate galleon {i}") for i in range(3)] + [("c", 0, "other words")], "cluster_id string, pos long, text string")
    targets = spark.createDataFrame([("a",), ("b",)], "cluster_id string")
    got = {r.cluster_id: r.label for r in title_labeler(complete, sample=4)(texts, targets).collect()}
    assert got["a"] == "The Tide Turns" and "pirate" in got["b"] and set(got) == {"a", "b"}
    assert asked[0].count("\n- ") == 4 and clean("") == "" and len(clean("x " * 90)) <= 80


def test_terms_beyond_the_pool(spark):
    from driftclust.functions.terms import distinctive

    scores = spark.createDataFrame([("g", "ab" * (50 - i), float(50 - i)) for i in range(40)] + [("g", "zz", 1.0), ("g", "yy", 0.5), ("h", "one", 2.0), ("h", "two", 1.0)], "source string, term string, score double")
    got = {r.source: list(r.terms) for r in distinctive(scores, "source", 3, pool=10).collect()}
    assert got == {"g": ["ab" * 50, "zz", "yy"], "h": ["one", "two"]}


def test_package_offers():
    import driftclust

    assert driftclust.Config is Config and driftclust.ClusteringEngine and "replay" in dir(driftclust)
    with pytest.raises(AttributeError):
        driftclust.nothing
