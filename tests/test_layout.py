"""Neighbour graph and layout against brute force and by what they preserve."""

from __future__ import annotations

import numpy as np

from driftclust.operators import layout as Y

SCHEMA = "id long, embedding array<float>"


def groups(n=90, dim=10, seed=1):
    rng = np.random.default_rng(seed)
    middle = 3 * rng.standard_normal((3, dim))
    x = middle[np.arange(n) % 3] + rng.standard_normal((n, dim))
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_graph_equals_brute_force(spark):
    x = groups(40).astype(float)
    x[5] = x[4]
    d = np.sqrt(np.maximum(2 - 2 * x @ x.T, 0))
    like = np.zeros((40, 40))
    for i in range(40):
        near = sorted((j for j in range(40) if j != i), key=lambda j: (round(d[i, j], 7), j))[:6]
        own = d[i, near]
        over = np.maximum(own - own[own > 1e-6].min(), 0)
        low, high = 0.0, 1e3
        for _ in range(60):
            middle = (low + high) / 2
            low, high = (middle, high) if np.exp(-over / middle).sum() < np.log2(6) else (low, middle)
        like[i, near] = np.exp(-over / high)
    both = like + like.T - like * like.T
    got = {(r.a, r.b): r.w for r in Y.fuzzy_graph(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>"), 6).collect()}
    assert set(got) == {(i, j) for i in range(40) for j in range(i + 1, 40) if both[i, j] > 0}
    assert all(abs(w - both[p]) < 1e-4 for p, w in got.items())


def test_layout_keeps_groups_together(spark):
    x = groups()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(500, [0.0] * 10), (501, None), (3, x[3].tolist())], SCHEMA)
    got = {r.id: np.array(r.embedding) for r in Y.layout(rows, 2, n_neighbors=8, rounds=4).collect()}
    assert set(got) == set(range(90)) and all(len(v) == 2 and np.isfinite(v).all() for v in got.values())
    y = np.array([got[i] for i in range(90)])
    near = np.argsort(((y[:, None] - y[None]) ** 2).sum(2), axis=1)[:, 1:6]
    assert (near % 3 == (np.arange(90) % 3)[:, None]).mean() > 0.95
    assert Y.layout(rows.where("false"), 2).count() == 0


def test_discovery_in_a_layout(spark):
    from tests.test_engine import engine, items

    e = engine(spark)
    e.config = e.config.with_values(reducer="neighbours", umap_components=2, umap_neighbors=6)
    e.ingest(items("sea", 14) + items("code", 14, 5))
    report = e.discover()
    assert report.snapshot_size == 28 and 1 <= len(report.opened) <= 3
    places = {r.id: r.cluster_id for r in e.store.snapshot().places().collect() if r.cluster_id}
    for c in set(places.values()):
        assert len({i.rstrip("0123456789") for i, x in places.items() if x == c}) == 1  # no cluster mixes both
