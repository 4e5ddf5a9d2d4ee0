"""Neighbour embedding: vectors in few dimensions, near ones near each other, from a fuzzy graph of nearest neighbours."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftclust.operators.cells import CellIndex, unit
from driftclust.operators.dedupe import numbered
from driftclust.operators.scoring import matrix
from driftclust.session import settled

#: How likeness falls with distance, 1 / (1 + A d^2B), for points that may touch.
A, B = 1.929, 0.7915
#: The most that one neighbour or sample moves a point along an axis.
CLIP = 4.0


def _weights(n: int):
    """Likeness of an item to its neighbours: 1 up to the nearest other vector, then falling so that the sum is log2 of their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, others, out = [], [], []
            for item, near in zip(batch.column("id").to_pylist(), batch.column("near").to_pylist()):
                near = [x for x in near if x["id"] != item][:n]
                d = np.sqrt(np.maximum(2 - 2 * np.array([x["sim"] for x in near]), 0))
                if not len(d):
                    continue
                first = d[d > 1e-6].min(initial=np.inf)
                over = np.maximum(d - (first if np.isfinite(first) else 0), 0)
                low, high, wanted = 0.0, 1e3, np.log2(max(len(d), 2))
                for _ in range(60):
                    middle = (low + high) / 2
                    low, high = (middle, high) if np.exp(-over / middle).sum() < wanted else (low, middle)
                ids += [item] * len(near)
                others += [x["id"] for x in near]
                out += np.exp(-over / max(high, 1e-9)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.column("id").type), pa.array(others, batch.column("id").type), pa.array(out, pa.float64())], ["id", "other", "w"])

    return run


def fuzzy_graph(vectors: DataFrame, n_neighbors: int = 15, recall: float | None = None) -> DataFrame:
    """(a, b, w), a < b: how alike two vectors (id, embedding) are if either is among the nearest of the other: of the two likenesses the sum less the
    product. Neighbours come from cells, exactly or, with a ``recall``, approximately."""
    index = CellIndex(vectors, "id")
    probes = None if recall is None else index.probes_for(vectors, n_neighbors + 1, recall, "id")
    near = index.nearest(vectors, n_neighbors + 1, "id", probes=probes)
    near = near.groupBy(F.col("item.id").alias("id")).agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), F.col("key.id").alias("id"), "sim"))).alias("near"))
    kind = vectors.schema["id"].dataType.simpleString()
    one_way = near.select("id", "near").mapInArrow(_weights(n_neighbors), f"id {kind}, other {kind}, w double")
    pairs = one_way.groupBy(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).agg(F.sum("w").alias("s"), F.min("w").alias("l"), F.max("w").alias("h"), F.count("*").alias("n"))
    return pairs.select("a", "b", F.when(F.col("n") > 1, F.col("s") - F.col("l") * F.col("h")).otherwise(F.col("s")).alias("w"))


def _products(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros((dim + 1, dim)), 0
        for batch in batches:
            x = unit(matrix(batch.column("embedding"), dim))
            sums[0] += x.sum(axis=0)
            sums[1:] += x.T @ x
            n += len(x)
        row, col = np.indices(sums.shape).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(row.astype(np.int32)), pa.array(col.astype(np.int32)), pa.array(sums.ravel())], ["i", "j", "x"])

    return run


def _axes(vectors: DataFrame, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean and the leading principal axes, from sums of products made in tasks."""
    dim = len(vectors.select("embedding").first().embedding)
    found = vectors.select("embedding").mapInArrow(_products(dim), "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).toArrow()
    sums = np.zeros((dim + 1, dim))
    sums[found.column("i").to_numpy(), found.column("j").to_numpy()] = found.column("x").to_numpy()
    n = vectors.count()
    mean = sums[0] / n
    _, axes = np.linalg.eigh(sums[1:] / n - np.outer(mean, mean))
    return mean, axes[:, ::-1][:, :dims]


def layout(vectors: DataFrame, dims: int = 2, n_neighbors: int = 15, rounds: int = 12, negatives: int = 5, recall: float | None = None, seed: int = 42) -> DataFrame:
    """(id, embedding): positions of vectors (id, embedding) in ``dims`` dimensions, starting from their principal components.

    In each round neighbours draw a point towards them by their likeness, and ``negatives`` points drawn anew push it away; it moves by the mean of these,
    less from round to round. All points move at once: edges and samples meet positions in joins, sums are made by point, and each round is written to
    the shared folder. Seeded; rows with null or zero vectors have no position, of repeated ids one row counts.
    """
    points = vectors.select("id", F.col("embedding").cast("array<double>").alias("embedding")).where(F.exists("embedding", lambda x: x != 0)).groupBy("id").agg(F.any_value("embedding").alias("embedding"))
    points = settled(numbered(points, "id", 0), "layout-points")
    n = points.count()
    y = [f"y{i}" for i in range(dims)]
    if not n:
        return vectors.sparkSession.createDataFrame([], f"id {vectors.schema['id'].dataType.simpleString()}, embedding array<float>")
    mean, axes = _axes(points, dims)
    dims_there = axes.shape[1]
    at = lambda i: sum((F.lit(float(a)) * (F.col("u")[k] - float(m)) for k, (a, m) in enumerate(zip(axes[:, i], mean))), F.lit(0.0)) if i < dims_there else F.lit(0.0)
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x * x))
    start = points.select("seq", F.transform("embedding", lambda x: x / length).alias("u")).select("seq", *(at(i).alias(c) for i, c in enumerate(y)))
    most = start.agg(F.max(F.greatest(*(F.abs(c) for c in y), F.lit(0.0)))).first()[0] or 1.0
    now = settled(start.select("seq", *((F.col(c) * (10.0 / most)).alias(c) for c in y)), "layout")
    graph = fuzzy_graph(points, n_neighbors, recall)
    ids = points.select("id", "seq")
    edges = graph.join(ids.withColumnRenamed("id", "a").withColumnRenamed("seq", "i"), "a").join(ids.withColumnRenamed("id", "b").withColumnRenamed("seq", "j"), "b").select("i", "j", "w")
    edges = settled(edges.unionAll(edges.select(F.col("j").alias("i"), F.col("i").alias("j"), "w")), "layout-edges")
    weight = settled(edges.groupBy(F.col("i").alias("seq")).agg(F.sum("w").alias("all")), "layout-weights")
    clip = lambda x: F.greatest(F.least(x, F.lit(CLIP)), F.lit(-CLIP))
    for r in range(rounds):
        square = sum(((F.col(c) - F.col(f"o_{c}")) ** 2 for c in y), F.lit(0.0))
        other = now.select(F.col("seq").alias("j"), *(F.col(c).alias(f"o_{c}") for c in y))
        pulled = edges.join(now.withColumnRenamed("seq", "i"), "i").join(other, "j").withColumn("d", square)
        pull = F.when(F.col("d") > 0, -2 * A * B * F.col("d") ** (B - 1) / (1 + A * F.col("d") ** B)).otherwise(0.0)
        pulled = pulled.select(F.col("i").alias("seq"), *((F.col("w") * clip(pull * (F.col(c) - F.col(f"o_{c}")))).alias(f"g_{c}") for c in y))
        drawn = now.join(weight, "seq").select("*", F.explode(F.array(*(F.pmod(F.xxhash64("seq", F.lit(seed * 1_000_003 + r * 101 + k)), F.lit(n)) + 1 for k in range(negatives)))).alias("j"))
        pushed = drawn.where("j <> seq").join(other, "j").withColumn("d", square)
        push: Column = 2 * B / ((0.001 + F.col("d")) * (1 + A * F.col("d") ** B))
        pushed = pushed.select("seq", *((F.col("all") / negatives * clip(push * (F.col(c) - F.col(f"o_{c}")))).alias(f"g_{c}") for c in y))
        moved = pulled.unionAll(pushed).groupBy("seq").agg(*(F.sum(f"g_{c}").alias(f"g_{c}") for c in y)).join(weight, "seq")
        step = F.lit(1 - r / rounds) / F.col("all")
        now = settled(now.join(moved, "seq", "left").select("seq", *((F.col(c) + F.coalesce(step * F.col(f"g_{c}"), F.lit(0.0))).alias(c) for c in y)), "layout")
    return points.select("id", "seq").join(now, "seq").select("id", F.array(*(F.col(c).cast("float") for c in y)).alias("embedding"))
