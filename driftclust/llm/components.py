"""Connected components of a link table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import cut, drop_cut


def _stars(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step on links (low, high), low < high."""
    both = links.select(F.col("low").alias("u"), F.col("high").alias("v")).unionAll(links.select(F.col("high").alias("u"), F.col("low").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("high"), F.col("m").alias("low"))
    roots = large.groupBy("high").agg(F.min("low").alias("root"))
    small = large.join(roots, "high").where("low > root").select(F.col("root").alias("low"), F.col("low").alias("high"))
    return small.unionAll(roots.select(F.col("root").alias("low"), "high")).distinct()


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.sum(F.xxhash64("low", "high").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link; the component is its smallest node.

    ``links`` has distinct rows (low, high) with low < high. Each round is written to the shared folder, so that a lost
    executor costs one round; the rounds end when the links no longer change, after a number of rounds that grows with
    the logarithm of the longest path. Nothing is gathered on the driver but a count and a checksum of each round.
    """
    now = cut(links.select("low", "high"), "links")
    mark = _mark(now)
    while True:
        after = cut(_stars(now), "links")
        drop_cut(now)
        now, before, mark = after, mark, _mark(after)
        if mark == before:
            break
    return now.select(F.col("high").alias("node"), F.col("low").alias("component")).unionAll(now.select(F.col("low").alias("node"), F.col("low").alias("component")).distinct())
