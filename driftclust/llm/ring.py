"""Sharding on a consistent-hash ring with virtual nodes and bounded loads, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.llm.common import packed
from driftclust.llm.order import BITS, point, row_point, sum_before

#: Leading bits of a place on the ring: 4096 sectors, by which a key finds its virtual node.
SECTOR_BITS = 12
#: Finer cells in which keys are put in order.
CELL_BITS = 16


def ring(df: DataFrame, shards: int, nodes: int) -> DataFrame:
    """The virtual nodes: arc (their number in ring order), pos, shard. ``shards * nodes`` rows."""
    spark = df.sparkSession
    made = spark.range(shards * nodes).select((F.col("id") % shards).cast("int").alias("shard"), point(F.concat_ws(":", F.lit("node"), F.col("id") % shards, F.expr(f"id div {shards}"))).alias("pos"))
    return made.withColumn("arc", (F.row_number().over(W.orderBy("pos", "shard")) - 1).cast("int"))


def shard_documents(documents: DataFrame, shards: int = 16, nodes: int = 64) -> DataFrame:
    """``documents`` with size, text_crc32, law, shard, slot and grown_shard: counts of rows in shards differ by one at most (law ``rows``).

    Each shard has ``nodes`` virtual nodes on a ring; a key, the md5 of a doc_id, belongs to the next virtual node clockwise. A shard
    takes its own keys, in ring order, up to its load: the rows divided by the shards, one more in the first shards where that
    leaves a remainder. Keys beyond go on clockwise to the next shard with room, arc after arc. Loads add up to the rows, so every shard is
    filled exactly; what moves against the plain ring is only what overflows. slot numbers the rows of a shard from 0.

    Counts are gathered by arc and cell, shards * nodes + 2**CELL_BITS rows at most, and the overflow of the arcs is dealt out as a fold over those
    counts; rows themselves are ordered only within a cell. ``size`` is the UTF-8 bytes of the text plus 1; a null text has size 1 and the
    crc of nothing, 0. Rows without a doc_id have
    their texts for keys. Repeated rows are rows of their own. Columns named like the results are replaced, others may have any name.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    base, back = packed(documents, "doc_id", "text")
    bytes_ = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = base.select("*", (F.octet_length(bytes_) + 1).cast("long").alias("size"), F.crc32(bytes_).alias("text_crc32"), row_point(F.col("doc_id"), F.col("text")).alias("__at"))

    arcs = ring(documents, shards, nodes)
    by_sector = arcs.groupBy(F.shiftright("pos", BITS - SECTOR_BITS).cast("int").alias("__sector")).agg(F.sort_array(F.collect_list(F.struct("pos", "arc"))).alias("own"))
    sectors = documents.sparkSession.range(1 << SECTOR_BITS).select(F.col("id").cast("int").alias("__sector"))
    ahead = W.orderBy("__sector").rowsBetween(1, W.unboundedFollowing)
    sectors = sectors.join(by_sector, "__sector", "left").select("__sector", F.coalesce("own", F.array().cast("array<struct<pos:bigint,arc:int>>")).alias("__own"), F.coalesce(F.first(F.get("own", F.lit(0))["arc"], ignorenulls=True).over(ahead), F.lit(0)).alias("__next"))
    rows = rows.withColumn("__sector", F.shiftright("__at", BITS - SECTOR_BITS).cast("int")).join(F.broadcast(sectors), "__sector")  # 2**SECTOR_BITS rows
    rows = rows.withColumn("__arc", F.expr("coalesce(get(filter(__own, x -> x.pos >= __at), 0).arc, __next)")).drop("__sector", "__own", "__next")

    # keys of the first arc that come after the last virtual node stand before those at the ring's start
    last = arcs.agg(F.max("pos").alias("__last"))
    rows = rows.crossJoin(F.broadcast(last)).withColumn("__at", F.when(F.col("__at") > F.col("__last"), F.col("__at") - F.lit(1 << BITS)).otherwise(F.col("__at"))).drop("__last")  # one row on the right
    rows = rows.withColumn("__cell", F.shiftright("__at", BITS - CELL_BITS).cast("int")).withColumn("__one", F.lit(1).cast("long"))

    counts = rows.groupBy("__arc").agg(F.count("*").alias("n"))
    loads = arcs.join(counts.select(F.col("__arc").alias("arc"), "n"), "arc", "left").select("arc", "shard", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    everything = W.partitionBy()
    before = W.partitionBy("shard").orderBy("arc").rowsBetween(W.unboundedPreceding, -1)
    loads = loads.withColumn("all", F.sum("n").over(everything)).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long"))
    loads = loads.withColumn("load", F.expr(f"all div {shards} + if(shard < all % {shards}, 1, 0)"))
    loads = loads.withColumn("kept", F.greatest(F.lit(0).cast("long"), F.least("n", F.col("load") - F.col("before"))))
    listed = loads.agg(F.sort_array(F.collect_list(F.struct("arc", "shard", "n", "kept", "before", "load"))).alias("a"))
    listed = listed.select("a", F.expr("transform(a, x -> x.shard)").alias("owner"), F.expr(f"transform(sequence(0, {shards - 1}), s -> coalesce(get(filter(a, x -> x.shard = s), 0).load, 0L))").alias("load"))
    listed = listed.withColumn("room", F.expr("transform(load, (c, s) -> c - aggregate(filter(a, x -> x.shard = s), 0L, (t, x) -> t + x.kept))"))
    dealt = F.expr(
        """
        aggregate(
          filter(a, x -> x.n > x.kept),
          struct(room, cast(array() as array<struct<arc:int,shard:int,start:bigint,n:bigint,slot:bigint>>) as out),
          (state, x) -> aggregate(
            array_distinct(concat(slice(owner, x.arc + 2, size(owner)), slice(owner, 1, x.arc + 1))),
            struct(state.room as room, state.out as out, x.n - x.kept as left, 0L as start),
            (s, shard) -> if(s.left = 0 or s.room[shard] = 0, s, struct(
              transform(s.room, (r, i) -> if(i = shard, r - least(r, s.left), r)) as room,
              concat(s.out, array(struct(x.arc as arc, shard as shard, s.start as start, least(s.room[shard], s.left) as n, load[shard] - s.room[shard] as slot))) as out,
              s.left - least(s.room[shard], s.left) as left,
              s.start + least(s.room[shard], s.left) as start)),
            s -> struct(s.room as room, s.out as out)),
          state -> state.out)
        """
    )
    plan = listed.select("a", dealt.alias("d")).select(F.expr("explode(transform(a, x -> struct(x.arc as __arc, x.shard as home, x.kept as kept, x.before as before, filter(d, y -> y.arc = x.arc) as over)))").alias("p")).select("p.*")

    rows = sum_before(rows, ["__arc"], "__cell", ["__at", "doc_id", "size", "text_crc32"], "__one", "__rank")
    rows = rows.join(F.broadcast(plan), "__arc")  # shards * nodes rows, with shards overflow parts each at most
    rows = rows.withColumn("__to", F.expr("get(filter(over, y -> __rank - kept between y.start and y.start + y.n - 1), 0)"))
    at_home = F.col("__rank") < F.col("kept")
    return rows.select(
        *(back(c) for c in documents.columns if c not in made),
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        F.when(at_home, F.col("home")).otherwise(F.col("__to.shard")).cast("int").alias("shard"),
        F.when(at_home, F.col("before") + F.col("__rank")).otherwise(F.col("__to.slot") + F.col("__rank") - F.col("kept") - F.col("__to.start")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
