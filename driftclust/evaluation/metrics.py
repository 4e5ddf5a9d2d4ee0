"""Quality of clusterings against labelled items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.operators.timeline import final_closes
from driftclust.schema import ARCHIVED, ASSIGNED, CLOSED
from driftclust.session import settled

NOISE = "noise"
#: Share of a cluster that its second topic may have before the cluster counts as mixed.
TOLERANCE = 0.10


def topic_counts(items: DataFrame) -> DataFrame:
    """(cluster_id, label, n) of items (cluster_id, label) in clusters."""
    return items.where("cluster_id is not null and label is not null").groupBy("cluster_id", "label").agg(F.count("*").alias("n"))


def majorities(items: DataFrame) -> DataFrame:
    """(cluster_id, majority, n, total): the most frequent label of each cluster, the first by name among equals."""
    counts = topic_counts(items)
    best = counts.groupBy("cluster_id").agg(F.min(F.struct((-F.col("n")).alias("low"), "label")).alias("b"), F.sum("n").alias("total"))
    return best.select("cluster_id", F.col("b.label").alias("majority"), (-F.col("b.low")).alias("n"), "total")


def mixed_clusters(items: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(cluster_id, second_share, mixed): the share of its second topic among a cluster's items with a topic, and whether that is
    ``tolerance`` or more. Noise is no topic."""
    counts = topic_counts(items)
    topical = counts.where(F.col("label") != NOISE)
    total = topical.groupBy("cluster_id").agg(F.sum("n").alias("total"))
    rank = F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("n"), "label"))
    second = topical.withColumn("rank", rank).where("rank = 2").select("cluster_id", F.col("n").alias("second"))
    share = F.coalesce(F.col("second") / F.col("total"), F.lit(0.0))
    found = counts.select("cluster_id").distinct().join(total, "cluster_id", "left").join(second, "cluster_id", "left")
    return found.select("cluster_id", share.alias("second_share"), (F.col("second").isNotNull() & (share >= tolerance)).alias("mixed"))


def hours(later, earlier):
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(3_600_000_000)


def summary(items: DataFrame, clusters: DataFrame, events: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of metrics from items (id, ts, label, cluster_id, status), all labelled, clusters and events: items, labeled_items, clusters, topics,
    topics_detected, precision, mixed_clusters, false_merge_rate, fragmentation, orphan_rate, topic_orphan_rate, median_detect_hours,
    median_close_lag_hours, buffered. Ratios of nothing are null."""
    items = items.withColumn("cluster_id", F.when(F.col("status") == ASSIGNED, F.col("cluster_id")))
    labelled = items.where("label is not null")
    topical = labelled.where(F.col("label") != NOISE)
    major = majorities(items)
    of_topic = major.where(F.col("majority") != NOISE)
    counts = items.agg(F.count("*").alias("items"), F.count("label").alias("labeled_items"), F.count_if(F.col("status") == "buffered").alias("buffered"), F.round(F.avg(F.when(F.col("status") != ASSIGNED, 1.0).otherwise(0.0)), 4).alias("orphan_rate"))
    # the lag of a topic counts once all of its clusters have closed for good
    topics = topical.agg(F.countDistinct("label").alias("topics"), F.round(F.avg(F.when(F.col("status") != ASSIGNED, 1.0).otherwise(0.0)), 4).alias("topic_orphan_rate"))
    hits = major.agg(F.count("*").alias("clusters"), F.round(F.sum("n") / F.sum("total"), 4).alias("precision"))
    detected = of_topic.agg(F.countDistinct("majority").alias("topics_detected"), F.round(F.count("*") / F.countDistinct("majority"), 3).alias("fragmentation"))
    merged = mixed_clusters(items, tolerance).agg(F.count_if("mixed").alias("mixed_clusters"), F.round(F.avg(F.col("mixed").cast("double")), 4).alias("false_merge_rate"))
    spans = topical.groupBy("label").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    opened = of_topic.join(clusters.select(F.col("id").alias("cluster_id"), "opened_at"), "cluster_id").groupBy(F.col("majority").alias("label")).agg(F.min("opened_at").alias("opened_at"))
    detect = spans.join(opened, "label").agg(F.round(F.median(hours(F.col("opened_at"), F.col("first"))), 2).alias("median_detect_hours"))
    shut = clusters.where(F.col("status").isin(CLOSED, ARCHIVED)).select(F.col("id").alias("cluster_id")).join(final_closes(events), "cluster_id")
    ended = of_topic.join(shut, "cluster_id", "left").groupBy(F.col("majority").alias("label")).agg(F.max("closed_at").alias("closed_at"), F.count("*").alias("all"), F.count("closed_at").alias("shut")).where(F.col("all") == F.col("shut"))
    lag = spans.join(ended, "label").agg(F.round(F.median(hours(F.col("closed_at"), F.col("last"))), 2).alias("median_close_lag_hours"))
    out = counts
    for one in (topics, hits, detected, merged, detect, lag):  # single rows
        out = out.crossJoin(one)
    return out.select("items", "labeled_items", "clusters", "topics", "topics_detected", "precision", "mixed_clusters", "false_merge_rate", "fragmentation", "orphan_rate", "topic_orphan_rate", "median_detect_hours", "median_close_lag_hours", "buffered")


def status_counts(rows: DataFrame, statuses: tuple[str, ...], column: str = "status") -> DataFrame:
    """(status, n) for each of the given statuses, 0 where there are none."""
    spark = rows.sparkSession
    known = spark.range(1).select(F.explode(F.array(*(F.lit(s) for s in statuses))).alias(column))
    counts = rows.groupBy(column).agg(F.count("*").alias("n"))
    return known.join(counts, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def pareto_front(rows: DataFrame, key: str, x: str, y: str) -> DataFrame:
    """Rows that no other row beats: lower or equal in both costs and lower in one.

    The least y of each x is made on the map side; of those a row is on the front if its y is under all y of smaller x. The running
    minimum goes over distinct x in ranges, so no task sees all of them.
    """
    least = rows.groupBy(x).agg(F.min(y).alias(y))
    parts = settled(least.repartitionByRange(x).withColumn("__part", F.spark_partition_id()), "front-ranges")
    lows = parts.groupBy("__part").agg(F.min(y).alias("__low"), F.min(x).alias("__x"))
    ahead = lows.select("__part", F.min("__low").over(W.orderBy("__x").rowsBetween(W.unboundedPreceding, -1)).alias("__before"))
    inside = F.min(y).over(W.partitionBy("__part").orderBy(x).rowsBetween(W.unboundedPreceding, -1))
    front = parts.withColumn("__inside", inside).join(F.broadcast(ahead), "__part").where((F.col("__inside").isNull() | (F.col(y) < F.col("__inside"))) & (F.col("__before").isNull() | (F.col(y) < F.col("__before")))).select(x, y)
    return rows.join(front, [x, y], "left_semi")
