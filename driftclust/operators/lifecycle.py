"""Lifecycle decisions over the cluster table, each a filter or a small join; ``now`` is always an argument."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftclust.operators.cells import similar_pairs
from driftclust.operators.scoring import centroids, symmetric_similarity
from driftclust.schema import ARCHIVED, BUFFERED, CLOSED, OPEN
from driftclust.session import settled

#: How far under the merge threshold the centroids of a pair may be for the pair to be compared in full.
PREFILTER_MARGIN = 0.15


def _at(moment: datetime) -> Column:
    return F.lit(moment)


def matchable(clusters: DataFrame, now: datetime, grace: timedelta) -> DataFrame:
    """Clusters that items can join: all open ones, and closed ones without a status lock up to and with the end of the grace."""
    return clusters.where((F.col("status") == OPEN) | ((F.col("status") == CLOSED) & ~F.col("status_locked") & (F.col("closed_at") >= _at(now - grace))))


def quiet(clusters: DataFrame, item_times: DataFrame, now: datetime, close_after: timedelta, least: int = 1) -> DataFrame:
    """Open clusters without a status lock that had fewer than ``least`` items (cluster_id, ts) strictly after now - close_after.

    With a ``least`` of 1 the cluster's last_seen says so, and no items are counted.
    """
    cutoff = _at(now - close_after)
    open_ = clusters.where((F.col("status") == OPEN) & ~F.col("status_locked"))
    if least <= 1:
        return open_.where(F.col("last_seen") <= cutoff)
    recent = item_times.where(F.col("ts") > cutoff).groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("__recent"))
    return open_.join(recent, "id", "left").where(F.coalesce("__recent", F.lit(0)) < least).select(*open_.columns)


def expired(clusters: DataFrame, now: datetime, grace: timedelta) -> DataFrame:
    """Closed clusters whose grace is over, status locks or not."""
    return clusters.where((F.col("status") == CLOSED) & (F.col("closed_at") < _at(now - grace)))


def stale(items: DataFrame, now: datetime, max_age: timedelta) -> DataFrame:
    """Buffered items, locked ones too, that are older than max_age by their own time."""
    return items.where((F.col("status") == BUFFERED) & (F.col("ts") < _at(now - max_age)))


def grown(clusters: DataFrame, growth: float) -> DataFrame:
    """Open clusters that have grown by the factor since they were labelled."""
    return clusters.where((F.col("status") == OPEN) & (F.col("size") >= F.greatest(F.lit(1), F.col("label_size")) * F.lit(growth)))


def merge_candidates(clusters: DataFrame, exemplars: DataFrame, barred: DataFrame, threshold: float, k: int, margin: float = PREFILTER_MARGIN) -> DataFrame:
    """(a, b, similarity) of pairs a < b of ``clusters`` whose exemplars are at least ``threshold`` similar; ``barred`` pairs left out.

    Only pairs whose centroids come within ``margin`` of the threshold are compared in full; a join by cells finds them (``cells.similar_pairs``).
    """
    middle = centroids(exemplars.join(clusters.select(F.col("id").alias("cluster_id")), "cluster_id", "left_semi"))
    near = similar_pairs(middle.withColumnRenamed("centroid", "embedding"), threshold - margin, "cluster_id").select("a", "b")
    near = near.join(barred.select("a", "b"), ["a", "b"], "left_anti")
    return symmetric_similarity(exemplars, exemplars, near, k).where(F.col("similarity") >= threshold)


def greedy_pairs(pairs: DataFrame) -> DataFrame:
    """(a, b, similarity): most similar pairs first, ties by name, each cluster once.

    In each round all pairs are taken that come first at both of their clusters, and those that touch them go. Under a total order this takes the very
    pairs that going through them one by one takes, in as many rounds as pairs in a row depend on each other. Rounds are written to
    the shared folder; the driver counts. Null names or similarities pair nothing; of a repeated pair the most similar counts.
    """
    left = settled(pairs.select("a", "b", "similarity").where("a IS NOT NULL AND b IS NOT NULL AND similarity IS NOT NULL AND a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "pairs")
    taken = []
    while left.limit(1).count():
        place = F.struct((-F.col("similarity")).alias("s"), "a", "b")
        ends = left.select(F.explode(F.array("a", "b")).alias("id"), place.alias("place")).groupBy("id").agg(F.min("place").alias("place"))
        first = settled(ends.groupBy("place").count().where("count = 2").select("place.a", "place.b", (-F.col("place.s")).alias("similarity")), "pairs-taken")
        taken.append(first)
        done = first.select(F.explode(F.array("a", "b")).alias("id"))
        left = settled(left.join(done.withColumnRenamed("id", "a"), "a", "left_anti").join(done.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "similarity"), "pairs")
    out = left
    for t in taken:
        out = out.unionAll(t)
    return out


def survivors(pairs: DataFrame, clusters: DataFrame) -> DataFrame:
    """(a, b, survivor, absorbed): of a pair the larger survives, then the one opened first, then the first by name."""
    rank = clusters.select("id", F.struct((-F.col("size")).alias("s"), "opened_at", "id").alias("rank"))
    both = pairs.join(rank.select(F.col("id").alias("a"), F.col("rank").alias("ra")), "a").join(rank.select(F.col("id").alias("b"), F.col("rank").alias("rb")), "b")
    return both.select("a", "b", F.least("ra", "rb")["id"].alias("survivor"), F.greatest("ra", "rb")["id"].alias("absorbed"))


def attach(clusters: DataFrame, arrivals: DataFrame) -> DataFrame:
    """``clusters`` with size, seen_count and times moved by the arrivals (cluster_id, ts); closed ones among them are open again."""
    delta = arrivals.groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("__n"), F.min("ts").alias("__first"), F.max("ts").alias("__last"))
    hit = F.col("__n").isNotNull()
    moved = {
        "status": F.when(hit, F.lit(OPEN)).otherwise(F.col("status")),
        "closed_at": F.when(hit, F.lit(None)).otherwise(F.col("closed_at")),
        "size": F.col("size") + F.coalesce("__n", F.lit(0)),
        "seen_count": F.col("seen_count") + F.coalesce("__n", F.lit(0)),
        "first_seen": F.least("first_seen", "__first"),
        "last_seen": F.greatest("last_seen", "__last"),
    }
    return clusters.join(delta, "id", "left").select(*((moved[c] if c in moved else F.col(c)).cast(clusters.schema[c].dataType).alias(c) for c in clusters.columns))


def close(clusters: DataFrame, ids: DataFrame, now: datetime) -> DataFrame:
    return _mark(clusters, ids, {"status": F.lit(CLOSED), "closed_at": _at(now)})


def archive(clusters: DataFrame, ids: DataFrame) -> DataFrame:
    return _mark(clusters, ids, {"status": F.lit(ARCHIVED)})


def _mark(clusters: DataFrame, ids: DataFrame, values: dict[str, Column]) -> DataFrame:
    flagged = clusters.join(ids.select("id", F.lit(True).alias("__hit")), "id", "left")
    return flagged.select(*((F.when(F.col("__hit"), values[c]).otherwise(F.col(c)) if c in values else F.col(c)).cast(clusters.schema[c].dataType).alias(c) for c in clusters.columns))


def resolve(clusters: DataFrame) -> DataFrame:
    """(id, final, hops): where the merge pointers of each cluster lead. Pointers are doubled, so a chain of n takes log2 n joins, each round written
    to the shared folder. A pointer to a cluster that isn't there ends at it. A cycle, which commits never make, is an error: its hops grow beyond the
    number of clusters."""
    at = settled(clusters.select("id", F.coalesce("merged_into", "id").alias("to"), F.when(F.col("merged_into").isNull(), 0).otherwise(1).cast("long").alias("hops")), "pointers")
    rows = at.count()
    while True:
        nxt = at.select(F.col("id").alias("to"), F.col("to").alias("then"), F.col("hops").alias("more"))
        stepped = settled(at.join(nxt, "to", "left").select("id", F.coalesce("then", "to").alias("to"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops")), "pointers")
        before, after = (x.agg(F.sum("hops"), F.max("hops")).first() for x in (at, stepped))
        if (after[1] or 0) > rows:
            raise ValueError("merge pointers go round in a circle")
        if before[0] == after[0]:
            return stepped.select("id", F.col("to").alias("final"), "hops")
        at = stepped
