"""Identity of items: first occurrences, known ids, dense numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.session import settled


def first_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """(key, order) of the first row of each key; ``min`` combines on the map side, so a hot key is no hot task."""
    return rows.groupBy(key).agg(F.min(order).alias(order))


def unknown(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't known yet. Of the known keys, which may be all there ever were, only those of the rows are compared: where the rows are few,
    they are sent to the known ones, which then aren't shuffled."""
    hits = known.select(key).join(rows.select(key).distinct(), key, "left_semi")
    return rows.join(hits, key, "left_anti")


def numbered(rows: DataFrame, order: str, after: int, name: str = "seq", parts: int = 64) -> DataFrame:
    """Rows with dense numbers from ``after`` + 1 in the order of a column with distinct values.

    Ranges of the order are counted first, so no task numbers all rows: each range starts where those before it end. The bounds of ranges come from a
    sample that differs from run to run, so the ranged rows are written once and both counted and numbered from there.
    """
    ranged = settled(rows.repartitionByRange(parts, order).withColumn("__part", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("__part").agg(F.count("*").alias("__n"), F.min(order).alias("__low"))
    before = sizes.select("__part", F.coalesce(F.sum("__n").over(W.orderBy("__low").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    inside = F.row_number().over(W.partitionBy("__part").orderBy(order))
    return ranged.withColumn("__inside", inside).join(F.broadcast(before), "__part").withColumn(name, (F.col("__before") + F.col("__inside") + after).cast("long")).drop("__part", "__before", "__inside")
