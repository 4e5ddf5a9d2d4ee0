"""Cluster labels: class-based TF-IDF terms."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftclust.session import dealt, settled, spread

# English words that say little about a topic.
STOP_WORDS = tuple(
    "a about above across after again against all almost alone along already also although always am among an and another any are around as at back be became because been before behind being below between both but by can cannot could did do does down during each either else enough even ever every few for from further had has have he hence her here hers him his how however i if in into is it its itself just last least less many may me more most much must my neither never next no nobody none nor not nothing now of off often on once one only or other others our out over own per perhaps quite rather re same seem several she should since so some still such than that the their them then there these they this those though through thus to together too toward under until up upon us very was we well were what when where whether which while who whom whose why will with within without would yet you your".split()
)


_WORD = re.compile(r"\b\w\w+\b")
_STOP = frozenset(STOP_WORDS)
#: Distinct terms that a task holds before it gives their counts away.
HELD = 1 << 18


def words_of(text: str | None) -> list[str]:
    """Words of two or more word characters, lower case, without stop words."""
    return [w for w in _WORD.findall(text.lower()) if w not in _STOP] if text else []


def _counted(texts: DataFrame, group: str, longest: int) -> DataFrame:
    """(group, term, n): counts of terms as tasks give them away, at most about HELD terms at once."""
    kind = texts.schema[group].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush() -> pa.RecordBatch:
            groups = pa.array([g for g, counts in held.items() for _ in counts], batch.schema.field(0).type)
            found = pa.RecordBatch.from_arrays([groups, pa.array([t for c in held.values() for t in c], pa.string()), pa.array([n for c in held.values() for n in c.values()], pa.int64())], [group, "term", "n"])
            held.clear()
            return found

        batch, size = None, 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = words_of(text.as_py())
                counts = held.setdefault(name, Counter())
                size -= len(counts)
                for n in range(longest):
                    counts.update(words if not n else map(" ".join, zip(*(words[i:] for i in range(n + 1)), strict=False)))
                size += len(counts)
                if size > HELD:
                    yield flush()
                    size = 0
        if batch is not None:
            yield flush()

    return spread(texts.select(group, "text")).mapInArrow(run, f"`{group}` {kind}, term string, n long")


def term_counts(texts: DataFrame, group: str = "cluster_id", longest: int = 2) -> DataFrame:
    """(group, term, n): terms of 1 to ``longest`` words of a text, stop words left out before words are joined. Counted in Arrow batches, so that
    counts, not occurrences, are shuffled."""
    return dealt(_counted(texts, group, longest), texts, "term").groupBy(group, "term").agg(F.sum("n").alias("n"))


def _ends(texts: DataFrame, group: str) -> DataFrame:
    """(group, pos, first, last): the first and the last word of each text that has any."""
    schema = texts.select(group, "pos").schema.add("first", "string").add("last", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [words_of(x.as_py()) for x in batch.column(2)]
            some = pa.array([bool(w) for w in words], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(some), batch.column(1).filter(some), pa.array([w[0] for w in words if w], pa.string()), pa.array([w[-1] for w in words if w], pa.string())], schema.names)

    return spread(texts.select(group, "pos", "text")).mapInArrow(run, schema)


def term_scores(counts: DataFrame, group: str = "cluster_id") -> DataFrame:
    """(group, term, score) from rows (group, term, n), one for each term of a group: the term's share of its group times
    ln(1 + mean terms of a group / count overall). The counts are made once and written with those overall, which rest on them."""
    counts = settled(counts.withColumn("term_n", F.sum("n").over(W.partitionBy("term"))), "terms")  # a row for each group at most
    totals = counts.groupBy(group).agg(F.sum("n").alias("group_n"))
    mean = totals.agg((F.sum("group_n") / F.count("*")).alias("mean_n"))
    scored = counts.join(totals, group).crossJoin(F.broadcast(mean))  # one row on the right
    return scored.select(group, "term", (F.col("n") / F.col("group_n") * F.log(1 + F.col("mean_n") / F.col("term_n"))).alias("score")).where("score > 0")


def _fold(group: str, n: int):
    """Over rows sorted by (group, score downward, term): the n first terms of each group, none containing another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, kept, kind = None, None, None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], kind), pa.array([kept], pa.list_(pa.string()))], [group, "terms"])

        for batch in batches:
            kind = batch.schema.field(0).type
            for name, term in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if kept is None or name != now:
                    if kept is not None:
                        yield out()
                    now, kept = name, []
                if len(kept) < n and not any(term in k or k in term for k in kept):
                    kept.append(term)
        if kept is not None:
            yield out()

    return run


def distinctive(scores: DataFrame, group: str = "cluster_id", n: int = 5, pool: int = 200) -> DataFrame:
    """(group, terms): the n best terms of each group, best first, leaving out one that contains or is contained in a better one.

    The ``pool`` best terms, taken on the map side, nearly always hold them. Groups that they don't fill are folded over all of
    their terms, in order.
    """
    schema = scores.select(group).schema.add("terms", T.ArrayType(T.StringType()))
    order = W.partitionBy(group).orderBy(F.desc("score"), F.asc("term"))
    fold = lambda rows: rows.select(group, "term", "score").repartition(group).sortWithinPartitions(group, F.desc("score"), "term").select(group, "term").mapInArrow(_fold(group, n), schema)
    found = settled(fold(scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= pool)), "terms-best")  # a row for each group
    if found.where(F.size("terms") < n).isEmpty():
        return found
    short = found.where(F.size("terms") < n).join(scores.groupBy(group).agg(F.count("*").alias("all")).where(F.col("all") > pool), group, "left_semi").select(group)
    return found.join(short, group, "left_anti").unionByName(fold(scores.join(short, group, "left_semi")))


def labels(texts: DataFrame, group: str = "cluster_id", n: int = 5, targets: DataFrame | None = None) -> DataFrame:
    """(group, label) from rows (group, pos, text): terms of one word and of two, which also run from a text to the next one in order of
    pos. ``targets`` names the groups that want a label; the others serve as contrast.

    Pairs within a text are made where the text is; only the first and last words of texts are put in order.
    """
    edges = _ends(texts, group)
    before = F.lag("last").over(W.partitionBy(group).orderBy("pos"))
    across = edges.select(group, F.concat(before, F.lit(" "), "first").alias("term")).where("term is not null").withColumn("n", F.lit(1).cast("long"))
    counts = dealt(_counted(texts, group, 2).unionByName(across), texts, "term").groupBy(group, "term").agg(F.sum("n").alias("n"))
    scores = term_scores(counts, group)
    if targets is not None:
        scores = scores.join(targets.select(group), group, "left_semi")
    return distinctive(scores, group, n).select(group, F.array_join("terms", " · ").alias("label"))
