"""Cells of vectors, pairs and pointers against brute force."""

from __future__ import annotations

import random

import numpy as np
import pytest

from driftclust.operators import assign as A
from driftclust.operators import cells as C
from driftclust.operators import discover as D
from driftclust.operators import lifecycle as L
from driftclust.operators import scoring

SCHEMA = "k long, embedding array<float>"


def vectors(n=400, dim=12, seed=0):
    rng = np.random.default_rng(seed)
    middle = rng.standard_normal((6, dim))
    x = middle[rng.integers(0, 6, n)] + 0.3 * rng.standard_normal((n, dim))
    x[7], x[8], x[9:40] = 0, x[3], x[2]  # a zero vector and a group of copies
    return x.astype(np.float32)


def frame(spark, x):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None)], SCHEMA).repartition(3)


def cosines(x):
    y = x.astype(float)
    length = np.linalg.norm(y, axis=1, keepdims=True)
    y = np.divide(y, length, out=np.zeros_like(y), where=length > 0)
    return y @ y.T, np.flatnonzero(length[:, 0] > 0)


@pytest.mark.parametrize("n_cells,block", [(None, 512), (1, 512), (9, 16), (60, 7)])
def test_exact_search_equals_brute_force(spark, monkeypatch, n_cells, block):
    monkeypatch.setattr(C, "BLOCK", block)
    x = vectors()
    index = C.CellIndex(frame(spark, x), "k", n_cells=n_cells)
    assert index.sizes.sum() == 399  # every row but the null and the zero vector
    got = {}
    for r in index.nearest(frame(spark, x).where("k % 9 = 0"), 7, "k", probes=None).collect():
        got.setdefault(r.item.k, {})[r["rank"]] = (r.key.k, r.sim)
    sims, there = cosines(x)
    assert set(got) == {int(i) for i in there if i % 9 == 0}
    for i, found in got.items():
        best = sorted((-sims[i, j], j) for j in there)[:7]
        assert np.allclose([found[r][1] for r in range(1, 8)], [-s for s, _ in best], atol=1e-6)
        if len({round(s, 6) for s, _ in best}) == 7:
            assert [found[r][0] for r in range(1, 8)] == [j for _, j in best]


def test_probes_reach_the_recall(spark):
    x = vectors(1500, 24, 3)
    df = frame(spark, x)
    index = C.CellIndex(df, "k", n_cells=40)
    probes = index.probes_for(df, 10, 0.95, "k")
    assert 1 <= probes < 40
    items = df.where("k % 10 = 3")
    exact, near = ({(r.item.k, r.key.k) for r in index.nearest(items, 10, "k", probes=p).collect()} for p in (None, probes))
    assert len(exact & near) >= 0.9 * len(exact) and index.nearest(items, 10, "k", probes=40).count() == len(exact)


@pytest.mark.parametrize("least", [0.95, 0.6, -0.2])
def test_pairs_over_a_cosine_equal_brute_force(spark, monkeypatch, least):
    monkeypatch.setattr(C, "BLOCK", 50)
    x = vectors(250, 12, 5)
    got = {(r.a, r.b): r.cosine for r in C.similar_pairs(frame(spark, x), least, "k", n_cells=20).collect()}
    sims, there = cosines(x)
    wanted = {(int(i), int(j)) for i in there for j in there if i < j and sims[i, j] >= least}
    sure = {p for p in wanted if sims[p] > least + 1e-9}
    assert sure <= set(got) <= {(int(i), int(j)) for i in there for j in there if i < j and sims[i, j] >= least - 1e-9}
    assert all(abs(got[p] - sims[p]) < 1e-9 for p in sure)


def test_empty_tables_and_few_rows(spark):
    none = spark.createDataFrame([], SCHEMA)
    x = frame(spark, vectors()[:3])
    assert C.CellIndex(none, "k").nearest(x, 3, "k", probes=None).count() == 0 == C.similar_pairs(none, 0.5, "k").count()
    assert C.CellIndex(x, "k").nearest(none, 3, "k").count() == 0 and C.CellIndex(x, "k").probes_for(none, 3, 0.9, "k") == 1
    assert C.CellIndex(x, "k").nearest(x, 5, "k", probes=None).count() == 9


def test_nearest_by_cells_decides_as_by_a_scan(spark):
    x = vectors(300, 12, 8)
    x[7] = x[6]
    items = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(x[:80])], "item_id string, embedding array<float>")
    exemplars = spark.createDataFrame([(f"c{i % 9}", i // 9, str(i), v.tolist()) for i, v in enumerate(x[80:])], "cluster_id string, pos int, item_id string, embedding array<float>")
    clusters = spark.createDataFrame([(f"c{i}", 0.2 + i / 20) for i in range(9)], "id string, threshold double")
    unit = [(i, (v / np.linalg.norm(v)).tolist()) for i, v in ((r.item_id, np.array(r.embedding)) for r in items.collect())]
    items = spark.createDataFrame(unit, items.schema)
    exemplars = exemplars.toPandas()
    exemplars["embedding"] = [(np.array(v) / np.linalg.norm(v)).tolist() for v in exemplars.embedding]
    exemplars = spark.createDataFrame(exemplars, "cluster_id string, pos int, item_id string, embedding array<float>")
    scan, found = (sorted(A.assign_nearest(items, exemplars, clusters, 15, 4, recall).collect()) for recall in (None, 1.0))
    assert sum(a.cluster_id == b.cluster_id for a, b in zip(scan, found, strict=True)) >= 78


def test_folds_are_those_of_all_pairs(spark):
    x = vectors(200, 6, 9)
    x[7] = x[6]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = lambda part, name, n: spark.createDataFrame([(f"{name}{i % n}", i // n, str(i), v.tolist()) for i, v in enumerate(part)], "cluster_id string, pos int, item_id string, embedding array<float>")
    found, live = (spark.createDataFrame([(f"{name}{i}",) for i in range(n)], "id string") for name, n in (("f", 8), ("l", 11)))
    fx, lx = rows(x[:64], "f", 8), rows(x[64:], "l", 11)
    pairs = found.selectExpr("id a").crossJoin(live.selectExpr("id b"))
    every = scoring.symmetric_similarity(fx, lx, pairs, 3).collect()
    for threshold in (0.3, 0.5, 0.9, 0.0):
        wanted = {}
        for a, b, s in every:
            if s >= threshold and (a not in wanted or (-s, b) < wanted[a]):
                wanted[a] = (-s, b)
        got = {r.id: r.target for r in D.best_overlaps(found, fx, live, lx, 3, threshold).collect()}
        assert got == {a: b for a, (_, b) in wanted.items()}


def in_turn(spark, found, named, drawn, live, exemplars, k, threshold, size):
    """One candidate after the other."""
    out = {}
    for i in [r.id for r in found.orderBy("min_seq").collect()]:
        one = found.where(found.id == i)
        got = D.best_overlaps(one, drawn, live, exemplars, k, threshold).collect()
        if got:
            out[i] = got[0].target
            joined = named.where(named.cluster_id == i).selectExpr(f"'{got[0].target}' as cluster_id", "id as item_id", "embedding")
            exemplars = scoring.draw_exemplars(exemplars.select("cluster_id", "item_id", "embedding").unionByName(joined), size, 42)
            exemplars = spark.createDataFrame(exemplars.collect(), exemplars.schema)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_folds_see_the_folds_before_them(spark, seed):
    rng = np.random.default_rng(seed)
    angle = lambda a: [float(np.cos(a)), float(np.sin(a)), 0.0]
    members, live_rows, found_rows = [], [], []
    for c, centre in enumerate([0.0, 2.0, 4.0]):
        live_rows += [(f"l{c}", p, f"l{c}-{p}", angle(centre + 0.05 * rng.standard_normal())) for p in range(4)]
    for i, at in enumerate([0.33, 0.66, 0.99, 2.33, 2.0, 5.2, 4.3][: 5 + seed]):  # each links the next to a cluster
        members += [(f"f{i}", f"f{i}-{m}", angle(at + 0.03 * rng.standard_normal())) for m in range(6)]
        found_rows.append((f"f{i}", i))
    named = spark.createDataFrame(members, "cluster_id string, id string, embedding array<float>")
    drawn = scoring.draw_exemplars(named.selectExpr("cluster_id", "id as item_id", "embedding"), 12, 42)
    found, live = spark.createDataFrame(found_rows, "id string, min_seq long"), spark.createDataFrame([(f"l{c}",) for c in range(3)], "id string")
    exemplars = spark.createDataFrame(live_rows, "cluster_id string, pos int, item_id string, embedding array<float>")
    threshold = 0.85
    got = D.folds_in_order(found, named, drawn, live, exemplars, 2, threshold, 12, 42)
    assert got == in_turn(spark, found, named, drawn, live, exemplars, 2, threshold, 12)
    before = {r.id: r.target for r in D.best_overlaps(found, drawn, live, exemplars, 2, threshold).collect()}
    assert got != before or seed  # what the folds before have brought


def test_what_an_earlier_fold_may_change_is_decided_later():
    final = lambda *a: D._settled(*a)
    assert final(["a", "b", "c"], {"a": "x", "b": "y"}, {"a": {"x"}, "b": {"y"}}, {}) == ["a", "b", "c"]
    assert final(["a", "b", "c"], {"a": "x", "b": "x"}, {"a": {"x"}, "b": {"x", "z"}, "c": {"z"}}, {}) == ["a"]  # b may go to z, and then c
    assert final(["a", "b"], {"a": "x"}, {"a": {"x"}}, {"b": {"a"}}) == ["a"] and final(["b", "a"], {"a": "x"}, {"a": {"x"}}, {"b": {"a"}}) == ["b", "a"]
    assert final(["a", "b"], {}, {"a": {"x"}, "b": {"x"}}, {}) == ["a", "b"]


@pytest.mark.parametrize("seed", range(4))
def test_greedy_pairs_equal_going_through_them_in_order(spark, seed):
    r = random.Random(seed)
    pairs = {(a, b): r.choice([0.9, 0.8, 0.8, 0.7, r.random()]) for a, b in ((f"n{i:02}", f"n{j:02}") for i in range(25) for j in range(i + 1, 25)) if r.random() < 0.3}
    taken, wanted = set(), set()
    for (a, b), s in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
        if not {a, b} & taken:
            taken |= {a, b}
            wanted.add((a, b, s))
    rows = [(a, b, s) for (a, b), s in pairs.items()] + [(a, b, s / 2) for (a, b), s in list(pairs.items())[:5]] + [(None, "n01", 1.0), ("n01", "n02", None), ("n03", "n03", 1.0)]
    r.shuffle(rows)
    got = L.greedy_pairs(spark.createDataFrame(rows, "a string, b string, similarity double"))
    assert {tuple(x) for x in got.collect()} == wanted
    assert L.greedy_pairs(spark.createDataFrame([], "a string, b string, similarity double")).count() == 0


def test_pointers_of_any_length_and_circles(spark):
    chain = spark.createDataFrame([(f"c{i}", f"c{i + 1}" if i < 40_000 else None) for i in range(40_001)] + [("x", "nowhere")], "id string, merged_into string")
    got = L.resolve(chain)
    assert got.where("id like 'c%' and final <> 'c40000'").count() == 0 and got.where("id = 'c0'").first().hops == 40_000 and got.where("id = 'x'").first().final == "nowhere"
    for circle in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "d"), ("d", "b"), ("e", None)]):
        with pytest.raises(ValueError):
            L.resolve(spark.createDataFrame(circle, "id string, merged_into string"))
