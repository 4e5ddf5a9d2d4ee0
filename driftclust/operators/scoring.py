"""Similarity of items to clusters through exemplars: draws, scores, thresholds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.functions.keys import draw_order
from driftclust.functions.vector import clamp, dot, norm, top_k_mean


def draw_exemplars(members: DataFrame, k: int, seed: int | None = 42) -> DataFrame:
    """(cluster_id, pos, item_id, embedding): k members of each cluster, at random but the same for a seed, in the order of their ids.

    A draw is the k smallest hashes, so draws merge: the draw from members and a batch is the draw from all. Only the k best rows of a
    task go into the shuffle.
    """
    drawn = W.partitionBy("cluster_id").orderBy("__order", "item_id")
    best = members.select("cluster_id", "item_id", "embedding", draw_order(seed, "cluster_id", "item_id").alias("__order")).withColumn("__rank", F.row_number().over(drawn)).where(F.col("__rank") <= k)
    return best.select("cluster_id", (F.row_number().over(W.partitionBy("cluster_id").orderBy("item_id")) - 1).alias("pos"), "item_id", "embedding")


def packed(exemplars: DataFrame) -> DataFrame:
    """One row for each cluster: its exemplars as an array, in order of pos."""
    rows = exemplars.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item_id", "embedding"))).alias("x"))
    return rows.select("cluster_id", F.transform("x", lambda e: e.item_id).alias("item_ids"), F.transform("x", lambda e: e.embedding).alias("vectors"))


#: Bytes of exemplars that are sent to the workers at once. What is larger takes more passes.
BLOCK_BYTES = 64 << 20
#: Items scored in one matrix product.
ROWS = 256


def matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """A column of vectors as rows in double precision."""
    flat = np.asarray(vectors.flatten(), np.float64)
    if len(flat) != len(vectors) * dim:
        raise ValueError(f"vectors of another dimension than the {dim} of the exemplars")
    return flat.reshape(len(vectors), dim)


def exemplar_parts(exemplars: DataFrame, key: str) -> Iterator[tuple[Column, pa.Table]]:
    """Exemplars in tables of at most about BLOCK_BYTES, dealt by the hash of a column and sorted by cluster and pos, each with the condition
    on that column that its rows meet. One is on the driver at a time."""
    size = exemplars.agg(F.sum(F.size("embedding") * 4)).first()[0] or 0
    parts = max(1, -(-int(size) // BLOCK_BYTES))
    for part in range(parts):
        mine = F.pmod(F.xxhash64(key), F.lit(parts)) == part if parts > 1 else F.lit(True)
        found = exemplars.where(mine).toArrow()
        yield mine, found.sort_by([("cluster_id", "ascending"), ("pos", "ascending")]).combine_chunks()


def similarities(vector: Column | str, vectors: Column | str) -> Column:
    return F.transform(vectors, lambda e: dot(vector, e))


def member_scores(members: DataFrame, exemplars: DataFrame, k: int) -> DataFrame:
    """(cluster_id, item_id, score): how well each member fits its own cluster without itself.

    The mean of the k best similarities to the exemplars other than the member. k is lowered, for a whole cluster, to the least
    number of exemplars that any of its members has left, but not below 1. A member without any has score 0.
    """
    members = members.select("cluster_id", "item_id", "embedding")
    own = exemplars.groupBy("cluster_id", "item_id").agg(F.count("*").alias("own")).join(members.select("cluster_id", "item_id"), ["cluster_id", "item_id"], "left_semi")
    most = own.groupBy("cluster_id").agg(F.max("own").alias("own"))
    least = exemplars.groupBy("cluster_id").agg(F.count("*").alias("have")).join(most, "cluster_id", "left").select("cluster_id", (F.col("have") - F.coalesce("own", F.lit(0))).alias("least"))
    tops = {r.cluster_id: max(1, min(k, r.least)) for r in least.collect()}  # clusters
    found = None
    for mine, table in exemplar_parts(exemplars, "cluster_id"):
        part = members.where(mine).mapInArrow(_member_scores(table, tops), "cluster_id string, item_id string, score double")
        found = part if found is None else found.unionAll(part)
    return found


def _member_scores(table: pa.Table, tops: dict[str, int]):
    names = table.column("cluster_id").to_pylist()
    ids = table.column("item_id").to_pylist()
    flat = np.asarray(table.column("embedding").combine_chunks().flatten(), np.float32) if names else np.zeros(0, np.float32)
    vectors = flat.reshape(len(names), -1) if names else flat.reshape(0, 0)
    edges = [i for i in range(len(names) + 1) if i in (0, len(names)) or names[i] != names[i - 1]]
    spans = {names[a]: (a, b, {x: [j for j in range(b - a) if ids[a + j] == x] for x in ids[a:b]}, tops[names[a]]) for a, b in zip(edges, edges[1:], strict=False)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clusters, items = batch.column("cluster_id").to_pylist(), batch.column("item_id").to_pylist()
            scores = np.zeros(len(items))
            known = np.array([c in spans for c in clusters], bool)
            groups: dict[str, list[int]] = {}
            for row in np.flatnonzero(known).tolist():
                groups.setdefault(clusters[row], []).append(row)
            for name, rows in groups.items():
                a, b, own, top = spans[name]
                sims = matrix(batch.column("embedding").take(pa.array(rows)), vectors.shape[1]) @ vectors[a:b].astype(np.float64).T
                left = np.full(len(rows), b - a)
                for i, row in enumerate(rows):
                    mine = own.get(items[row], ())
                    sims[i, list(mine)] = -np.inf
                    left[i] -= len(mine)
                best = -np.sort(-sims, axis=1)[:, :top]
                use = np.arange(best.shape[1]) < left[:, None]
                scores[rows] = np.where(use, best, 0).sum(axis=1) / np.maximum(use.sum(axis=1), 1)
            yield pa.RecordBatch.from_arrays([batch.column("cluster_id").filter(pa.array(known)), batch.column("item_id").filter(pa.array(known)), pa.array(scores[known])], ["cluster_id", "item_id", "score"])

    return run


def thresholds(scores: DataFrame, percentile: float, low: float, high: float) -> DataFrame:
    """(cluster_id, cohesion, threshold): the percentile of the members' scores with linear interpolation, as it is and between the bounds."""
    found = scores.groupBy("cluster_id").agg(F.percentile("score", F.lit(percentile / 100)).alias("cohesion"))
    return found.select("cluster_id", "cohesion", clamp("cohesion", low, high).alias("threshold"))


def symmetric_similarity(left: DataFrame, right: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, similarity) for pairs (a, b): half the mean top-k similarity from a's exemplars to b's, and half the way back. No exemplars: 0."""
    both = pairs.join(packed(left).select(F.col("cluster_id").alias("a"), F.col("vectors").alias("va")), "a", "left").join(packed(right).select(F.col("cluster_id").alias("b"), F.col("vectors").alias("vb")), "b", "left")
    way = lambda x, y: F.aggregate(F.transform(x, lambda e: top_k_mean(similarities(e, y), k)), F.lit(0.0), lambda s, v: s + v) / F.size(x)
    return both.select("a", "b", F.coalesce((way("va", "vb") + way("vb", "va")) / 2, F.lit(0.0)).alias("similarity"))


def centroids(vectors: DataFrame, group: str = "cluster_id") -> DataFrame:
    """(group, centroid): the mean vector at length 1, its norm taken as 1e-12 at least. Sums are made by coordinate on the map side."""
    means = vectors.select(group, F.posexplode("embedding").alias("dim", "x")).groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    mean = means.groupBy(group).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda e: e.x).alias("mean"))
    length = F.greatest(norm("mean"), F.lit(1e-12))
    return mean.select(group, F.transform("mean", lambda x: x / length).alias("centroid"))


def _nearest(table: pa.Table, n: int):
    """The n exemplars of a table that are nearest to each item; equal ones by cluster and pos, in which they are sorted."""
    names, pos = table.column("cluster_id").combine_chunks(), table.column("pos").combine_chunks()
    flat = np.asarray(table.column("embedding").combine_chunks().flatten(), np.float32) if len(names) else np.zeros(0, np.float32)
    vectors = flat.reshape(len(names), -1) if len(names) else flat.reshape(0, 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = np.ascontiguousarray(vectors.T, np.float64)
        for batch in batches:
            if not len(vectors):
                continue
            items = matrix(batch.column("embedding"), vectors.shape[1])
            for at in range(0, len(items), ROWS):
                far = -(items[at : at + ROWS] @ wide)
                limit = np.partition(far, n - 1, axis=1)[:, n - 1 : n] if far.shape[1] > n else np.full((len(far), 1), np.inf)
                row, col = np.nonzero(far <= limit)
                order = np.lexsort((col, far[row, col], row))
                row, col = row[order], col[order]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                row, col = row[rank < n], col[rank < n]
                yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row + at)), names.take(pa.array(col)), pos.take(pa.array(col)), pa.array(-far[row, col])], ["item_id", "cluster_id", "pos", "sim"])

    return run


def nearest_exemplars(items: DataFrame, exemplars: DataFrame, n: int, k: int, near: DataFrame | None = None) -> DataFrame:
    """(item_id, cluster_id, score) as a store's nearest-neighbour index gives them: of the n exemplars nearest to an item those of a
    cluster are summed, k best at most, and divided by the smaller of k and the cluster's number of exemplars; what isn't near counts 0.

    The exemplars are measured and sent in parts of at most about BLOCK_BYTES; the n nearest of each part are merged. ``near`` (item_id, cluster_id, pos, sim)
    stands for them where an index has found them.
    """
    sizes = exemplars.groupBy("cluster_id").agg(F.count("*").alias("have"))
    order = W.partitionBy("item_id").orderBy(F.desc("sim"), "cluster_id", "pos")
    parts = 0
    kind = exemplars.schema["pos"].dataType.simpleString()
    for _, table in exemplar_parts(exemplars.select("cluster_id", "pos", "embedding"), "cluster_id") if near is None else ():
        found = items.select("item_id", "embedding").mapInArrow(_nearest(table, n), f"item_id string, cluster_id string, pos {kind}, sim double")
        near, parts = found if near is None else near.unionAll(found), parts + 1
    if parts > 1:
        near = near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)
    best = near.groupBy("item_id", "cluster_id").agg(F.slice(F.sort_array(F.collect_list("sim"), asc=False), 1, k).alias("sims")).join(sizes, "cluster_id")
    return best.select("item_id", "cluster_id", (F.aggregate("sims", F.lit(0.0), lambda s, x: s + x) / F.least(F.lit(k), F.col("have"))).alias("score"))
