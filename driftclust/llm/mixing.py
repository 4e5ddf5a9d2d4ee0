"""Mixing sources to target weights by Pfair scheduling, in DataFrame and SQL functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.llm.common import packed
from driftclust.llm.order import BITS, row_point, sum_before

#: Leading bits of a document's place that name its cell.
CELL_BITS = 12
#: Runs that are made before they join the rest: a fold copies what it has gathered at each step.
PICKED = 256
#: Where rows without a slot stand: after all slots.
UNSLOTTED = 1 << 50


def root_weights(documents: DataFrame, most: int = 100) -> DataFrame:
    """Target weights (source, weight): whole numbers in proportion to the square root of the sources' bytes, the largest ``most``."""
    sizes = documents.groupBy("source").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).alias("bytes"))
    top = sizes.agg(F.max("bytes").alias("top"))
    return sizes.crossJoin(top).select("source", F.ceil(F.lit(most) * F.sqrt(F.col("bytes").cast("double")) / F.sqrt(F.col("top").cast("double"))).cast("int").alias("weight"))  # one row on the right


def pfair_runs(weights: DataFrame) -> DataFrame:
    """(weight, sources, period, k, first, start, n): runs of slots for sources of the same weight. Sources of one weight have the same releases and
    deadlines, so their k-th blocks are one bundle; a run gives slots start to start + n - 1 to the bundle's blocks from number ``first`` on.

    The fold steps from run to run: a run ends when its bundle is done or another bundle is released. It holds one row with as many entries
    as there are different weights, and makes two runs at most for each bundle, whatever the number of sources.
    """
    groups = weights.groupBy("weight").agg(F.count("*").alias("m")).agg(F.sort_array(F.collect_list(F.struct(F.col("weight").cast("long").alias("w"), "m"))).alias("g"))
    groups = groups.select(F.expr("transform(g, x -> x.w)").alias("w"), F.expr("transform(g, x -> x.m)").alias("m"), F.expr("aggregate(g, 0L, (a, x) -> a + x.w * x.m)").alias("period"), F.expr("aggregate(g, 0L, (a, x) -> a + 2 * x.w)").alias("most"))
    run = "struct<i:int,k:bigint,first:bigint,start:bigint,n:bigint>"
    step = """
        transform(
          array(array_min(transform(s.ks, (k, i) -> if(k * period div w[i] <= s.t, named_struct('due', ((k + 1) * period + w[i] - 1) div w[i], 'i', i), null)))),
          best -> transform(
            array(least(s.ls[best.i], coalesce(array_min(transform(s.ks, (k, i) -> if(k * period div w[i] > s.t, k * period div w[i], null))), period) - s.t)),
            n -> named_struct(
              't', s.t + n,
              'ks', transform(s.ks, (k, i) -> if(i = best.i and s.ls[i] = n, k + 1, k)),
              'ls', transform(s.ls, (l, i) -> if(i = best.i, if(l = n, m[i], l - n), l)),
              'part', concat(s.part, array(named_struct('i', best.i, 'k', s.ks[best.i], 'first', m[best.i] - s.ls[best.i], 'start', s.t, 'n', n)))))[0])[0]
    """
    runs = F.expr(
        f"""
        aggregate(
          if(period = 0, array(), sequence(0L, most div {PICKED})),
          named_struct('t', 0L, 'ks', transform(w, x -> 0L), 'ls', m, 'runs', cast(array() as array<{run}>)),
          (all, c) -> aggregate(
            sequence(1, {PICKED}),
            named_struct('t', all.t, 'ks', all.ks, 'ls', all.ls, 'part', cast(array() as array<{run}>)),
            (s, x) -> if(s.t >= period, s, {step}),
            s -> named_struct('t', s.t, 'ks', s.ks, 'ls', s.ls, 'runs', concat(all.runs, s.part))),
          all -> all.runs)
        """
    )
    listed = groups.select("w", "m", "period", F.explode(runs).alias("r"))
    return listed.select(F.expr("w[r.i]").alias("weight"), F.expr("m[r.i]").alias("sources"), "period", "r.k", "r.first", "r.start", "r.n")


def pfair_slots(weights: DataFrame) -> DataFrame:
    """(source, weight, period, slots): in which slots of a period a source's blocks stand, for whole positive weights.

    The period is the sum of the weights. Block k (from 0) of a source with weight w is released at floor(k * period / w) and due by
    ceil((k + 1) * period / w). Each slot goes to the released block with the earliest deadline, ties to the smaller weight and then to the source
    that comes first by name. Such unit jobs have a schedule that meets all deadlines, and earliest deadline first finds it; so at any
    time each source has less than a block more or less than its share. ``pfair_runs`` makes it for all sources of a weight together, and the
    sources take their slots in a join. Its time grows with the number of different weights times their sum, and with the period.
    """
    order = W.partitionBy("weight").orderBy(F.col("source").isNotNull(), "source")
    named = weights.select("source", F.col("weight").cast("long").alias("weight")).withColumn("place", (F.row_number().over(order) - 1).cast("long"))
    slots = pfair_runs(weights).select("weight", "period", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"), "first", "start").select("weight", "period", (F.col("first") + F.col("j")).alias("place"), (F.col("start") + F.col("j")).alias("slot"))
    taken = named.join(slots, ["weight", "place"]).groupBy("weight", "place", "period").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    return named.join(taken, ["weight", "place"]).select("source", F.col("weight").cast("int").alias("weight"), "period", "slots")


def mix_sources(documents: DataFrame, weights: DataFrame | None = None, block_bytes: int = 1 << 16) -> DataFrame:
    """``documents`` with n_bytes, block, block_offset and slot: in the order of slot and block_offset, sources are mixed to the weights.

    Documents of a source, in the order of the md5 of their doc_id, are cut into blocks of ``block_bytes`` (a document belongs to the
    block in which it begins; its size is its UTF-8 bytes plus 1). Blocks take the slots of ``pfair_slots``, period after period, so
    that after any slot each source that isn't exhausted has less than one block more or less than its target share. Slots of a
    source that has ended stay empty; the others go on in their proportion. Every row is placed.

    ``weights`` has (source, weight) for each source, whole and positive; without it, the roots of the sources' bytes. Rows of
    sources without a weight are put after all others, with a null slot. A null source is a source of its own, a null text an empty one;
    rows without a doc_id are ordered by the md5 of their texts. Repeated rows are placed one after the other. Columns named like the results are
    replaced, others may have any name.
    """
    made = ["n_bytes", "block", "block_offset", "slot"]
    weights = root_weights(documents) if weights is None else weights
    base, back = packed(documents, "doc_id", "text", "source")
    plan = pfair_slots(weights).select(F.col("source").alias("__source"), F.col("weight").cast("long").alias("__weight"), F.col("period").alias("__period"), F.col("slots").alias("__slots"))
    rows = base.select("*", (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)).cast("long").alias("n_bytes"), row_point(F.col("doc_id"), F.col("text")).alias("__at"), F.xxhash64("text").alias("__tie"))
    rows = rows.withColumn("__group", F.when(F.col("source").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "source"))).withColumn("__cell", F.shiftright("__at", BITS - CELL_BITS))
    rows = sum_before(rows, ["__group"], "__cell", ["__at", "doc_id", "n_bytes", "__tie"], "n_bytes", "__start")
    rows = rows.withColumn("block", F.expr(f"__start div {block_bytes}")).withColumn("block_offset", F.expr(f"__start % {block_bytes}"))
    rows = rows.join(plan, F.col("source").eqNullSafe(F.col("__source")), "left")
    rows = rows.withColumn("slot", F.expr("(block div __weight) * __period + __slots[cast(block % __weight as int)]"))
    return rows.select(*(back(c) for c in documents.columns if c not in made), *made)


def mixed_order(documents: DataFrame, weights: DataFrame | None = None, block_bytes: int = 1 << 16) -> DataFrame:
    """``documents`` in their mixed order, columns as before: written as files, part after part reads as the mix."""
    base, back = packed(documents, "doc_id", "text", "source")
    return mix_sources(base, weights, block_bytes).orderBy(F.asc_nulls_last("slot"), "block_offset", "doc_id").select(*map(back, documents.columns))


def mix_number(rows: DataFrame, group: str, slot: str, offset: str, out: str) -> DataFrame:
    """``rows`` with their number, from 0, in their group in the order of the mix: ``slot``, nulls last, ``offset`` and doc_id. Rows are
    put in order within 64 slots, or within 16 bytes of offset where there is no slot, and only those cells over a whole group."""
    cell = F.when(F.col(slot).isNull(), F.lit(UNSLOTTED) + F.shiftright(offset, 4)).otherwise(F.shiftright(slot, 6))
    rows = rows.withColumn("__mixed", F.coalesce(slot, F.lit(UNSLOTTED))).withColumn("__cell", cell).withColumn("__one", F.lit(1).cast("long"))
    return sum_before(rows, [group], "__cell", ["__mixed", offset, "doc_id"], "__one", out).drop("__mixed", "__cell", "__one")
