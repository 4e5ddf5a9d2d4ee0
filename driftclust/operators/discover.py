"""Discovery: dense groups of buffered items become candidate clusters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.functions.keys import cluster_id, draw_order
from driftclust.operators.cells import CellIndex
from driftclust.operators.density import density_labels, neighbours, reduce
from driftclust.operators.forest import exact, nearest
from driftclust.operators.scoring import draw_exemplars, member_scores, symmetric_similarity, thresholds
from driftclust.session import settled

#: Points whose nearest others, and so core distances, one task finds: a multiple of the rows that meet all others at once.
CORE_ROWS = 4096

_PACKED = pa.schema([("stream_key", pa.string()), ("part", pa.int32()), ("n", pa.int64()), ("ids", pa.list_(pa.string())), ("x", pa.binary())])


def fit_sample(items: DataFrame, most: int, seed: int | None) -> DataFrame:
    """``most`` items at random, the same for a seed. What isn't in the sample is matched to the clusters found afterwards."""
    return items.orderBy(draw_order(seed, "id"), "id").limit(most)


def groups(items: DataFrame, min_cluster_size: int, min_samples: int, components: int) -> DataFrame:
    """(id, label) of items (id, seq, embedding); -1 is noise. The whole input, which ``fit_sample`` bounds, is fitted together; with a
    ``stream_key`` column each stream is fitted by itself, in parallel. Nearest points, and so core distances, are found in tasks, CORE_ROWS points each, and only the tree grows in one."""
    key = "stream_key" if "stream_key" in items.columns else None

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("seq")
        x = exact(reduce(np.stack(table.column("embedding").to_numpy()), components))
        parts = range(-(-len(x) // CORE_ROWS))
        names = [table.column("id").to_pylist() if i == 0 else None for i in parts]
        return pa.table({"stream_key": [table.column("stream_key")[0].as_py()] * len(parts), "part": pa.array(parts, pa.int32()), "n": pa.array([len(x)] * len(parts), pa.int64()), "ids": pa.array(names, pa.list_(pa.string())), "x": pa.array([x.tobytes()] * len(parts), pa.binary())}, schema=_PACKED)

    def cores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                part, n = row.column("part")[0].as_py(), row.column("n")[0].as_py()
                x = np.frombuffer(row.column("x")[0].as_buffer(), np.float64).reshape(n, -1)
                near = nearest(x, neighbours(n, min_cluster_size, min_samples), part * CORE_ROWS, (part + 1) * CORE_ROWS)
                kept = row.column("x") if part == 0 else pa.array([None], pa.binary())
                yield pa.RecordBatch.from_arrays([*row.select(["stream_key", "part", "n", "ids"]).columns, kept, *(pa.array([a.tobytes()], pa.binary()) for a in near)], ["stream_key", "part", "n", "ids", "x", "d", "q"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        n, ids = table.column("n")[0].as_py(), table.column("ids")[0].as_py()
        x = np.frombuffer(table.column("x")[0].as_buffer(), np.float64).reshape(n, -1)
        near = tuple(np.concatenate([np.frombuffer(c.as_buffer(), kind) for c in table.column(name)]).reshape(n, -1) for name, kind in (("d", np.float64), ("q", np.int64)))
        labels = density_labels(x, min_cluster_size, min_samples, near)
        return pa.table({"id": pa.array(ids, pa.string()), "label": pa.array(labels, pa.int64()), "stream_key": pa.array([table.column("stream_key")[0].as_py()] * n, pa.string())})

    keyed = items.select("id", "seq", "embedding", (F.col(key) if key else F.lit("")).cast("string").alias("stream_key"))
    packed = keyed.groupBy("stream_key").applyInArrow(pack, "stream_key string, part int, n long, ids array<string>, x binary").repartition(items.sparkSession.sparkContext.defaultParallelism)
    found = packed.mapInArrow(cores, "stream_key string, part int, n long, ids array<string>, x binary, d binary, q binary")
    found = found.groupBy("stream_key").applyInArrow(fit, "id string, label long, stream_key string")
    return found if key else found.drop("stream_key")


def candidates(members: DataFrame, k: int, exemplars: int, percentile: float, bounds: tuple[float, float], seed: int | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """For groups (label, id, seq, ts, embedding): (clusters, members, exemplars). Clusters have label, id (of the founding members), size, cohesion,
    threshold, first_seen, last_seen, min_seq; members and exemplars carry the cluster id."""
    stats = members.groupBy("label").agg(cluster_id(F.collect_list("id")).alias("cluster_id"), F.count("*").alias("size"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.min("seq").alias("min_seq"))
    named = members.join(stats.select("label", "cluster_id"), "label")
    drawn = draw_exemplars(named.select("cluster_id", F.col("id").alias("item_id"), "embedding"), exemplars, seed)
    scores = member_scores(named.select("cluster_id", F.col("id").alias("item_id"), "embedding"), drawn, k)
    limits = thresholds(scores, percentile, *bounds)
    clusters = stats.join(limits, "cluster_id").select("label", F.col("cluster_id").alias("id"), "size", "cohesion", F.round("threshold", 6).alias("threshold"), "first_seen", "last_seen", "min_seq")
    return clusters, named, drawn


def linked(found: DataFrame, found_exemplars: DataFrame, live: DataFrame, live_exemplars: DataFrame, threshold: float) -> DataFrame:
    """(a, b): candidates and open clusters that may be as similar as ``threshold``. The similarity is a mean of cosines of exemplars, so a pair that
    reaches the threshold has two exemplars that do; a join by cells finds those."""
    if threshold <= 0:
        return found.select(F.col("id").alias("a")).crossJoin(live.select(F.col("id").alias("b")))  # all reach it
    own = lambda x, of: x.join(of.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi")
    met = CellIndex(own(live_exemplars, live), "cluster_id", "item_id").alike(own(found_exemplars, found), threshold - 1e-9, "cluster_id", "item_id")
    return met.select(F.col("item.cluster_id").alias("a"), F.col("key.cluster_id").alias("b")).distinct()


def best_overlaps(found: DataFrame, found_exemplars: DataFrame, live: DataFrame, live_exemplars: DataFrame, k: int, threshold: float, pairs: DataFrame | None = None) -> DataFrame:
    """(id, target, similarity): for each candidate the open cluster it is most similar to, where that reaches the threshold. Only ``linked`` pairs, or the
    ``pairs`` given, are compared in full."""
    pairs = linked(found, found_exemplars, live, live_exemplars, threshold) if pairs is None else pairs
    alike = symmetric_similarity(found_exemplars, live_exemplars, pairs, k).where(F.col("similarity") >= threshold)
    best = alike.groupBy("a").agg(F.min(F.struct((-F.col("similarity")).alias("low"), "b")).alias("m"))
    return best.select(F.col("a").alias("id"), F.col("m.b").alias("target"), (-F.col("m.low")).alias("similarity"))


def _settled(order: list[str], best: dict[str, str], reach: dict[str, set[str]], near: dict[str, set[str]]) -> list[str]:
    """Of candidates in their order those whose decision no earlier one can change. An earlier one matters to a candidate if it folds, or may yet, into a
    cluster that the candidate is linked with, or if its members are near the candidate, which they could then link with any cluster."""
    final, moving, open_ = [], set(), []
    for i in order:
        targets = set(reach.get(i, ()))
        if targets & moving or any(j in near.get(i, ()) for j in open_):
            moving |= targets  # undecided: it may fold into any of these, or into what it is near to
            open_.append(i)
            continue
        final.append(i)
        if i in best:
            moving.add(best[i])
            open_.append(i)
    return final


def folds_in_order(found: DataFrame, named: DataFrame, drawn: DataFrame, live: DataFrame, live_exemplars: DataFrame, k: int, threshold: float, exemplars: int, seed: int | None) -> dict[str, str]:
    """The open cluster that each candidate folds into, by name, decided in the order of min_seq: each candidate sees the exemplars as the folds before it
    have left them.

    Candidates that no earlier fold can matter to are decided in one round; the folds then move the exemplars, and the rest come in later rounds, so that most
    discoveries take one or two. ``found``, ``named`` (members) and ``drawn`` (exemplars) are the candidates; names and links of candidates, not items, come
    to the driver.
    """
    if not live.limit(1).count():
        return {}
    order = [r.id for r in found.select("id").orderBy("min_seq", "id").collect()]
    now, out = live_exemplars.select("cluster_id", "pos", "item_id", "embedding"), {}
    while order:
        left = found.join(found.sparkSession.createDataFrame([(i,) for i in order], "id string"), "id", "left_semi")
        pairs = settled(linked(left, drawn, live, now, threshold), "fold-links")
        best = {r.id: r.target for r in best_overlaps(left, drawn, live, now, k, threshold, pairs).collect()}
        reach: dict[str, set[str]] = {}
        for r in pairs.collect():
            reach.setdefault(r.a, set()).add(r.b)
        near: dict[str, set[str]] = {}
        if reach and len(order) > 1:
            own = left.select(F.col("id").alias("cluster_id"))
            able = named.join(own, "cluster_id", "left_semi").select("cluster_id", F.col("id").alias("item_id"), "embedding")
            met = CellIndex(able, "cluster_id", "item_id").alike(drawn.join(own, "cluster_id", "left_semi"), threshold - 1e-9, "cluster_id", "item_id")
            for r in met.select(F.col("item.cluster_id").alias("a"), F.col("key.cluster_id").alias("b")).where("a <> b").distinct().collect():
                near.setdefault(r.a, set()).add(r.b)
        final = _settled(order, best, reach, near)
        folded = [(i, best[i]) for i in final if i in best]
        out |= dict(folded)
        order = [i for i in order if i not in set(final)]
        if order and folded:
            into = found.sparkSession.createDataFrame(folded, "cluster_id string, target string")
            joined = named.join(into, "cluster_id").select(F.col("target").alias("cluster_id"), F.col("id").alias("item_id"), "embedding")
            now = settled(draw_exemplars(now.select("cluster_id", "item_id", "embedding").unionByName(joined), exemplars, seed), "fold-exemplars")
    return out
