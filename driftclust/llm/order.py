"""Positions in large groups without a window over a whole group: rows are dealt to cells by the leading bits of a hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Bits of a point on the ring that hashes fall on.
BITS = 60


def point(key: Column) -> Column:
    """A key's place in [0, 2**60), by its md5; a null has the place of the empty string."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def row_point(doc_id: Column, text: Column) -> Column:
    """A row's place by its doc_id; rows without one are dealt by their texts."""
    return point(F.coalesce(doc_id.cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text.cast("string"), F.lit("")).cast("binary")))))


def sum_before(rows: DataFrame, group: list[str], cell: str, order: list[str], value: str, out: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over the rows before it in its group, in the order of ``cell`` and then ``order``.

    ``cell`` must rise with the first column of ``order``. Sums of cells are made on the map side; only cells are put in order over a
    whole group, rows only within a cell, so that a group may hold any share of all rows.
    """
    cells = rows.groupBy(*group, cell).agg(F.sum(value).alias("__sum"))
    earlier = W.partitionBy(*group).orderBy(cell).rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select(*group, cell, F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).cast("long").alias("__before"))
    within = W.partitionBy(*group, cell).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(value).over(within), F.lit(0)).cast("long"))
    return rows.join(cells, [*group, cell]).withColumn(out, F.col("__before") + F.col("__inside")).drop("__before", "__inside")
