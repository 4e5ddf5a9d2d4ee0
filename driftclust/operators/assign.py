"""Assignment of items to clusters: an exemplar index, in blocks of bounded size, scored in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.operators.cells import CellIndex
from driftclust.operators.scoring import ROWS, matrix, nearest_exemplars
from driftclust.session import spread

#: Bytes of exemplars that are sent to the workers at once. A larger index is scored block by block.
INDEX_BYTES = 128 << 20

DECISIONS = "item_id string, cluster_id string, score double, runner_up_cluster_id string, runner_up_score double"


@dataclass
class Block:
    """Exemplars of some clusters, in the clusters' order, padded to the largest."""

    names: list[str]
    thresholds: np.ndarray
    places: np.ndarray
    tensor: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, table: pa.Table, first: int) -> Block:
        """From rows (place, cluster_id, threshold, vectors), numbered from ``first`` in the order of their places."""
        places = [tuple(p.values()) for p in table.column("place").to_pylist()]
        table = table.take(pa.array(sorted(range(len(places)), key=places.__getitem__), pa.int64())).combine_chunks()
        lists = table.column("vectors").combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        counts = np.diff(np.asarray(lists.offsets))
        flat = np.asarray(lists.flatten().flatten(), np.float32).reshape(int(counts.sum()), -1)
        tensor = np.zeros((len(counts), int(counts.max(initial=0)), flat.shape[1]), np.float32)
        tensor[np.repeat(np.arange(len(counts)), counts), np.arange(len(flat)) - np.repeat(np.cumsum(counts) - counts, counts)] = flat
        return cls(table.column("cluster_id").to_pylist(), np.asarray(table.column("threshold"), float), np.arange(first, first + len(counts)), tensor, counts)

    def wide(self) -> np.ndarray:
        """All exemplars as columns in double precision, made once for a task."""
        return np.ascontiguousarray(self.tensor.reshape(-1, self.tensor.shape[2]).T, np.float64)

    def scores(self, vectors: np.ndarray, k: int, wide: np.ndarray) -> np.ndarray:
        """Items by clusters: the mean of the k best similarities, of as many as the cluster has."""
        clusters, width, _ = self.tensor.shape
        sims = (vectors.astype(np.float64) @ wide).reshape(len(vectors), clusters, width)
        if (self.counts < width).any():
            sims[:, np.arange(width)[None, :] >= self.counts[:, None]] = -np.inf
        top = min(k, width)
        if top < width:
            sims.partition(width - top, axis=2)
        best = np.sort(sims[:, :, width - top :], axis=2)[:, :, ::-1]  # summed from the best down, as everywhere
        return np.where(np.isfinite(best), best, 0).sum(axis=2) / np.minimum(k, self.counts)


def _best(block: Block, k: int):
    """The two best clusters of each item in a block; equal scores in the clusters' order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wide = block.wide()
        for batch in batches:
            ids = batch.column("item_id")
            vectors = matrix(batch.column("embedding"), block.tensor.shape[2])
            parts = []
            for at in range(0, len(vectors), ROWS):
                scores = block.scores(vectors[at : at + ROWS], k, wide)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :2]
                parts.append((order, np.take_along_axis(scores, order, axis=1)))
            order = np.concatenate([p[0] for p in parts]) if parts else np.zeros((0, 1), int)
            score = np.concatenate([p[1] for p in parts]) if parts else np.zeros((0, 1))
            width = order.shape[1]
            rows = np.repeat(np.arange(len(vectors)), width)
            which = order.ravel()
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(rows)), pa.array([block.names[i] for i in which], pa.string()), pa.array(score.ravel(), pa.float64()), pa.array(block.thresholds[which], pa.float64()), pa.array(block.places[which], pa.int64())],
                ["item_id", "cluster_id", "score", "threshold", "place"],
            )

    return run


def index_rows(exemplars: DataFrame, clusters: DataFrame) -> DataFrame:
    """(place, cluster_id, threshold, vectors) of clusters that have exemplars; place is their order by opened_at and id."""
    vectors = exemplars.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("pos", "embedding"))).alias("x")).select("cluster_id", F.transform("x", lambda e: e.embedding).alias("vectors"))
    order = [F.col("opened_at").cast("timestamp")] if "opened_at" in clusters.columns else []
    placed = clusters.select(F.col("id").alias("cluster_id"), "threshold", F.struct(*order, "id").alias("place"))
    return placed.join(vectors, "cluster_id")


def _blocks(index: DataFrame) -> Iterator[Block]:
    """The index in blocks of at most about INDEX_BYTES, in order. Only one is on the driver at a time."""
    size = index.select(F.sum(F.size("vectors") * F.size(F.col("vectors")[0]) * 4).alias("b"), F.count("*").alias("n")).first()
    if not size.n:
        return
    parts = max(1, -(-int(size.b) // INDEX_BYTES))
    edges = [None]
    if parts > 1:
        edges += index.select("place").orderBy("place").selectExpr("place", "row_number() over (order by place) as r").where(F.col("r") % -(-size.n // parts) == 0).select("place").collect()
    place = 0
    for low, high in zip(edges, [*edges[1:], None], strict=True):
        part = index
        at = lambda row: F.struct(*(F.lit(v).alias(k) for k, v in row.place.asDict().items()))
        if low is not None:
            part = part.where(F.col("place") > at(low))
        if high is not None:
            part = part.where(F.col("place") <= at(high))
        found = part.toArrow()
        if found.num_rows:
            yield Block.of(found, place)
            place += found.num_rows


@dataclass
class Index:
    """All exemplars of live clusters on the driver, where they fit into one block; ``until`` is the last moment at which the same clusters are live."""

    key: tuple
    blocks: list[Block]
    until: Any

    def serves(self, key: tuple, now: Any) -> bool:
        return self.key == key and (self.until is None or now <= self.until)


def make_index(exemplars: DataFrame, clusters: DataFrame, key: tuple, until: Any) -> Index | None:
    """The index of clusters for later batches; None if it is larger than one block."""
    rows = index_rows(exemplars, clusters)
    if (rows.select(F.sum(F.size("vectors") * F.size(F.col("vectors")[0]) * 4)).first()[0] or 0) > INDEX_BYTES:
        return None
    return Index(key, list(_blocks(rows)), until)


def all_scores(items: DataFrame, exemplars: DataFrame, clusters: DataFrame, k: int) -> DataFrame:
    """(item_id, cluster_id, score) of all items (item_id, embedding) against all clusters that have exemplars."""

    def score(block: Block):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            wide, names = block.wide(), pa.array(block.names, pa.string())
            for batch in batches:
                vectors = matrix(batch.column("embedding"), block.tensor.shape[2])
                for at in range(0, len(vectors), ROWS):
                    scores = block.scores(vectors[at : at + ROWS], k, wide)
                    row, col = np.indices(scores.shape).reshape(2, -1)
                    yield pa.RecordBatch.from_arrays([batch.column("item_id").take(pa.array(row + at)), names.take(pa.array(col)), pa.array(scores.ravel())], ["item_id", "cluster_id", "score"])

        return run

    found = None
    for block in _blocks(index_rows(exemplars, clusters)):
        part = spread(items.select("item_id", "embedding")).mapInArrow(score(block), "item_id string, cluster_id string, score double")
        found = part if found is None else found.unionAll(part)
    return items.sparkSession.createDataFrame([], "item_id string, cluster_id string, score double") if found is None else found


def assign(items: DataFrame, exemplars: DataFrame, clusters: DataFrame, k: int, index: Index | None = None) -> DataFrame:
    """Decisions for items (item_id, embedding): cluster_id and score of the best cluster, null cluster where the score is under that
    cluster's threshold (then the item is buffered), and the runner-up. Scores are rounded to 6 digits after the decision.

    Each item is scored against all clusters by the mean of its k best similarities to the cluster's exemplars. The best cluster
    alone decides; ties go to the one opened first, then by id. Without clusters all results are null. Items don't see each other.
    An ``index`` made before stands for exemplars and clusters.
    """
    items = spread(items.select("item_id", "embedding"))
    found = None
    for block in _blocks(index_rows(exemplars, clusters)) if index is None else index.blocks:
        part = items.mapInArrow(_best(block, k), "item_id string, cluster_id string, score double, threshold double, place long")
        found = part if found is None else found.unionAll(part)
    if found is None:
        return items.select("item_id", *(F.lit(None).cast(t).alias(n) for n, t in (c.split() for c in DECISIONS.split(", ")[1:])))
    return decide(found)


def decide(scored: DataFrame) -> DataFrame:
    """Decisions from rows (item_id, cluster_id, score, threshold, place), two at most for each item and block of the index."""
    ranked = scored.groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("low"), "place", "cluster_id", "threshold"))).alias("r"))
    best, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    return ranked.select(
        "item_id",
        F.when(-best["low"] >= best["threshold"], best["cluster_id"]).alias("cluster_id"),
        F.round(-best["low"], 6).alias("score"),
        second["cluster_id"].alias("runner_up_cluster_id"),
        F.round(-second["low"], 6).alias("runner_up_score"),
    )


def assign_nearest(items: DataFrame, exemplars: DataFrame, clusters: DataFrame, n: int, k: int, recall: float | None = None) -> DataFrame:
    """As ``assign``, with scores from the n exemplars nearest to each item only: all exemplars are scanned, or, if a ``recall`` is given, the cells of
    an index that hold that share of them (``cells.CellIndex``). What is in no cell near enough has no score, nor has a zero vector then."""
    order = [F.col("opened_at")] if "opened_at" in clusters.columns else []
    placed = clusters.select(F.col("id").alias("cluster_id"), "threshold", F.struct(*order, F.col("id").alias("id")).alias("place"))
    near = None
    if recall is not None:
        index = CellIndex(exemplars, "cluster_id", "pos")
        found = index.nearest(items, n, "item_id", probes=index.probes_for(items, n, recall, "item_id"))
        near = found.select("item.item_id", "key.cluster_id", "key.pos", "sim")
    decided = decide(nearest_exemplars(items, exemplars, n, k, near).join(placed, "cluster_id"))
    return decided if near is None else items.select("item_id").join(decided, "item_id", "left")
