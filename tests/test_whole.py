"""Density groups of all vectors, fitted together in tasks."""

from __future__ import annotations

import numpy as np

from driftclust.operators import discover as D
from driftclust.operators.density import density_labels, merge_tree, reduce, spanning_tree, tree_labels
from driftclust.operators.forest import exact, quantum
from driftclust.operators.whole import whole_groups
from driftclust.plans import catalogue
from driftclust.plans.catalogue import QUERIES


def sizes(df) -> dict:
    return {r.label: r.n for r in df.collect()}


def partition(labels: np.ndarray) -> set:
    return {frozenset(np.flatnonzero(labels == k).tolist()) for k in set(labels.tolist()) - {-1}}


def frame(spark, x: np.ndarray):
    rows = [(str(i), i, v) for i, v in enumerate(x.astype(np.float32).tolist())]
    return spark.createDataFrame(rows, "id string, seq long, embedding array<float>")


def kruskal(x: np.ndarray, k: int) -> tuple[set, np.ndarray]:
    """The least spanning tree by brute force over all pairs, ties by distance, then rows; and its weights."""
    n, square = len(x), (x * x).sum(axis=1)
    d = square[:, None] + square[None, :] - 2 * x @ x.T
    core = np.partition(d, k - 1, axis=1)[:, k - 1]
    lo, hi = np.triu_indices(n, 1)
    w = np.maximum(d[lo, hi], np.maximum(core[lo], core[hi]))
    top, edges, weights = np.arange(n), set(), []
    for i in np.lexsort((hi, lo, d[lo, hi], w)).tolist():
        a, b = top[lo[i]], top[hi[i]]
        if a != b:
            top[top == b] = a
            edges.add((int(lo[i]), int(hi[i])))
            weights.append(w[i])
    return edges, np.sqrt(weights)


def crowded(n: int, dim: int, seed: int) -> np.ndarray:
    """Points at length 1: loose groups, strays, and exact copies, more of one point than a list holds."""
    r = np.random.default_rng(seed)
    x = r.normal(size=(n // 40, dim))[r.integers(0, n // 40, n)] + r.normal(size=(n, dim)) * r.choice([0.05, 0.3, 1.0], size=(n, 1))
    x[n // 2 : n // 2 + 60] = x[0]
    x[r.integers(0, n, n // 10)] = x[r.integers(0, n, n // 10)]
    return exact((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32))


def test_q51_fits_all_vectors_whatever_their_number(spark, monkeypatch):
    d = "/root/testdata/sf0.1"
    items = spark.read.parquet(f"{d}/embeddings.parquet").orderBy("vec_id").collect()
    labels = density_labels(reduce(np.array([r.embedding for r in items], np.float32), 5), 5, 3)
    expected = dict(zip(*(a.tolist() for a in np.unique(labels, return_counts=True)), strict=True))
    monkeypatch.setattr(catalogue, "FIT", 300, raising=False)  # the sample that was fitted before
    assert sizes(QUERIES["q51_discover_groups"](spark, d)) == expected


def test_spanning_trees_are_those_of_brute_force():
    for seed, dim, k in ((1, 3, 3), (2, 15, 3), (3, 4, 1), (4, 5, 30)):
        x = crowded(700, dim, seed)
        edges, weights = kruskal(x, k)
        found = spanning_tree(x, k)
        assert {(int(min(a, b)), int(max(a, b))) for a, b, _ in found} == edges and np.array_equal(found[:, 2], weights)
    for n in (2, 3, 5):
        assert len(spanning_tree(exact(np.eye(n)), min(3, n))) == n - 1


def test_groups_do_not_depend_on_the_order_of_rows_or_ties():
    x = crowded(600, 4, 7)
    labels = density_labels(x, 5, 3)
    order = np.random.default_rng(0).permutation(len(x))
    mixed = np.empty_like(labels)
    mixed[order] = density_labels(x[order], 5, 3)
    assert labels.max() > 3 and partition(labels) == partition(mixed) == partition(density_labels(x[:, ::-1], 5, 3))
    first = [int(np.flatnonzero(labels == k)[0]) for k in range(labels.max() + 1)]
    assert first == sorted(first)
    tree = spanning_tree(x, 3)
    ties = np.random.default_rng(1).permutation(len(tree))
    assert np.array_equal(tree_labels(merge_tree(tree[ties], len(x)), len(x), 5), labels)


def test_exact_vectors_have_exact_products():
    x = exact(np.random.default_rng(0).normal(size=(50, 64)) * 37)
    assert np.array_equal(x.astype(np.float32), x) and np.array_equal(x @ x.T, (x[:, ::-1] @ x[:, ::-1].T))
    assert quantum(1.0) == quantum(0.9999999) == quantum(1.0000001)


def test_whole_groups_over_several_packs_equal_those_in_memory(spark):
    x = crowded(5000, 12, 11)  # no reduction; two packs of homes, five of seekers
    found = {r.id: r.label for r in whole_groups(frame(spark, x), 5, 3, 1).collect()}
    labels = density_labels(x, 5, 3).tolist()
    assert len(found) == len(x) and [found[str(i)] for i in range(len(x))] == labels and max(labels) > 10
    assert found == {r.id: r.label for r in D.groups(frame(spark, x), 5, 3, 1).collect()}


def test_whole_groups_of_few_items(spark):
    assert whole_groups(frame(spark, np.eye(4)), 5, 3, 5).collect() == [(str(i), -1) for i in range(4)]
    assert whole_groups(frame(spark, np.eye(4)).limit(0), 5, 3, 5).count() == 0
    assert {r.label for r in whole_groups(frame(spark, np.ones((8, 4))), 5, 3, 5).collect()} == {0}
    assert {r.label for r in whole_groups(frame(spark, np.zeros((8, 4))), 5, 3, 5).collect()} == {0}
