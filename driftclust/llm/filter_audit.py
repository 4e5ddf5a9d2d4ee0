"""How filters overlap: packed bitmaps of filters, labels and parts, counted with AND-NOT and popcount for every set of earlier filters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.llm.common import SLICE_BYTES, SPACE, cut, own_columns, runs, utf8

#: Rows whose bitmaps stand in memory at once.
SLICE_ROWS = 1 << 18
#: Texts that are sent to all tasks, 50 bytes each, at most.
FREQUENT = 1000

_SIGNS = np.zeros(256, bool)
_SIGNS[list(b"#$%&*|")] = True


# --- the filters of one text ---------------------------------------------------------------------------------------


def _words(raw: bytes) -> tuple[int, int]:
    """How many words a text has and how many distinct ones. A long text is cut at white space, so that only its distinct words and one
    piece's words stand in memory."""
    if len(raw) <= SLICE_BYTES:
        words = raw.split()  # at the six ASCII spaces
        return len(words), len(set(words))
    n, seen, at = 0, set(), 0
    while at < len(raw):
        to = min(at + SLICE_BYTES, len(raw))
        while to < len(raw) and not SPACE[raw[to]]:
            to += 1
        words = raw[at:to].split()
        n, at = n + len(words), to
        seen.update(words)
    return n, len(seen)


def text_failures(texts: pa.Array) -> np.ndarray:
    """A byte for each text with a bit for each filter it fails by itself: 0 too few words (200), 1 under half of its words distinct, 2 over three
    capitals A-Z in 100 code points, 3 holds one of #$%&*|."""
    data, offsets = utf8(texts)
    out = np.zeros(len(texts), np.uint8)
    for a, b in runs(offsets):
        at, part = offsets[a : b + 1] - offsets[a], data[offsets[a] : offsets[b]]
        count = lambda what: np.diff(np.concatenate([[0], np.cumsum(what)])[at])  # noqa: B023, E731
        chars, capitals, signs = count((part & 0xC0) != 0x80), count((part >= 65) & (part <= 90)), count(_SIGNS[part])
        raw = part.tobytes()
        words = np.array([_words(raw[i:j]) for i, j in zip(at[:-1], at[1:])], np.int64).reshape(-1, 2)
        fails = [words[:, 0] < 200, 100 * words[:, 1] < 50 * words[:, 0], 100 * capitals > 3 * chars, signs > 0]
        out[a:b] = sum(f.astype(np.uint8) << i for i, f in enumerate(fails))
    return out


def _flag(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        keys = [hashlib.sha256((t.as_buffer() if t.is_valid else b"") or b"").digest() for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(text_failures(texts).astype(np.int16), pa.int16()), pa.array(keys, pa.binary())], ["doc_id", "part", "mask", "key"])


def flagged(documents: DataFrame) -> DataFrame:
    """(doc_id, part, mask): the filters that each row fails, bit 4 for a text that a smaller doc_id has too. Texts meet by their SHA-256. The slim rows
    are written once; of each text's rows a task shuffles only a count and the smallest and largest doc_id. Texts that hold a share of
    1 / FREQUENT of all rows, of which there are FREQUENT at most, are sent to all tasks; the rows of all others are joined by text."""
    rows = own_columns(documents, "doc_id", "lang", "text").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
    rows = cut(rows.mapInArrow(_flag, "doc_id long, part string, mask short, key binary").withColumn("part", F.coalesce("part", F.lit(""))), "flags")
    copies = cut(rows.groupBy("key").agg(F.min("doc_id").alias("__first"), F.max("doc_id").alias("__last"), F.count("*").alias("__n")).where("__first < __last").drop("__last"), "copies")
    most = rows.count() / FREQUENT
    frequent, others = (copies.where(c).drop("__n") for c in (F.col("__n") >= most, F.col("__n") < most))
    marked = rows.join(F.broadcast(frequent), "key", "left")
    rest = marked.where("__first IS NULL").drop("__first").join(others, "key", "left").select(marked.columns)
    later = F.when(F.col("doc_id") > F.col("__first"), F.lit(16)).otherwise(F.lit(0))
    return marked.where("__first IS NOT NULL").unionAll(rest).select("doc_id", "part", F.col("mask").bitwiseOR(later.cast("short")).alias("mask"))


# --- bitmaps -------------------------------------------------------------------------------------------------------


class BitmapIndex:
    """Packed bitmaps of some rows: one for each filter and each label, and for each part the run of words that holds its rows.

    Rows are ordered by part and each part begins a word of 64 rows, so a part's own bitmap is zero outside of its run, and a count within every
    part is one pass over the words, however many parts there are.
    """

    def __init__(self, parts: np.ndarray, masks: np.ndarray, n_filters: int):
        order = np.argsort(parts, kind="stable")
        codes, sizes = np.unique(parts[order], return_counts=True)
        words = (sizes + 63) // 64
        self.codes, self.starts = codes, np.concatenate([[0], np.cumsum(words)[:-1]]).astype(np.int64)
        first = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self._at = np.arange(len(parts)) - np.repeat(first, sizes) + np.repeat(self.starts * 64, sizes)
        self._order, self._bits = order, int(words.sum()) * 64
        self.rows = self.pack(np.ones(len(parts), bool))
        self.filters = [self.pack(masks >> i & 1 == 1) for i in range(n_filters)]

    def pack(self, what: np.ndarray) -> np.ndarray:
        bits = np.zeros(self._bits, bool)
        bits[self._at] = what[self._order]
        return np.packbits(bits, bitorder="little").view(np.uint64)

    def count(self, bitmap: np.ndarray) -> np.ndarray:
        """Rows of a bitmap in each part."""
        return np.add.reduceat(np.bitwise_count(bitmap).astype(np.int64), self.starts)


def _count(n_filters: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts of the rows of a task by part, set of earlier filters and next filter; the sums of a task grow with the parts, not its rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}

        def add(tables: list[pa.RecordBatch]) -> None:
            t = pa.Table.from_batches(tables)
            coded = t.column("part").combine_chunks().dictionary_encode()
            names = coded.dictionary.to_pylist()
            index = BitmapIndex(coded.indices.to_numpy(), t.column("mask").to_numpy(), n_filters)
            good, toxic = index.pack(t.column("good").to_numpy()), index.pack(t.column("toxic").to_numpy())
            out = np.zeros((len(index.codes), 1 << n_filters, n_filters, 4), np.int64)
            for earlier in range(1 << n_filters):
                left = index.rows
                for i in range(n_filters):
                    if earlier >> i & 1:
                        left = left & ~index.filters[i]
                n = index.count(left)
                for f in range(n_filters):
                    if not earlier >> f & 1:
                        removed = left & index.filters[f]
                        out[:, earlier, f] = np.stack([n, index.count(removed), index.count(removed & good), index.count(removed & toxic)], 1)
            for code, counts in zip(index.codes, out):
                totals[names[code]] = totals[names[code]] + counts if names[code] in totals else counts

        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= SLICE_ROWS:
                add(held)
                held, n = [], 0
        if held:
            add(held)
        steps = [(earlier, f) for earlier in range(1 << n_filters) for f in range(n_filters) if not earlier >> f & 1]
        for part, counts in totals.items():
            cells = np.stack([counts[e, f] for e, f in steps])
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(steps), pa.string()), *(pa.array([s[i] for s in steps], pa.int32()) for i in (0, 1)), *(pa.array(cells[:, i], pa.int64()) for i in range(4))], ["part", "earlier", "filter", "left", "removed", "good_lost", "toxic_lost"])

    return count


def prefix_counts(rows: DataFrame, n_filters: int) -> DataFrame:
    """(part, earlier, filter, left, removed, good_lost, toxic_lost): of the rows of a part that pass all filters of the set ``earlier`` (bits), how many
    there are, and how many the next filter takes out, good and toxic ones among them. ``rows`` has part, mask, good and toxic."""
    cells = rows.select("part", "mask", "good", "toxic").mapInArrow(_count(n_filters), "part string, earlier int, filter int, left long, removed long, good_lost long, toxic_lost long")
    return cells.groupBy("part", "earlier", "filter").agg(*(F.sum(c).alias(c) for c in ("left", "removed", "good_lost", "toxic_lost")))


def audit_filters(documents: DataFrame, labels: DataFrame, names: str = "ABCDE") -> DataFrame:
    """What each filter does at each place of each order, by language: a row for every part, order of the five filters and step.

    Filters: A under 200 words; B under half of the words distinct; C over three capitals A-Z in 100 code points; D one of #$%&*|; E the text
    of a smaller doc_id. ``names`` gives them letters. Of the part's documents: kept after the step; removed in it; redundant, those that fail the
    step's filter but went earlier; unique_fails, those that fail this filter only; good_lost and toxic_lost, removed ones with that label; shapley,
    removed by this filter summed over all orders.

    A null text is empty and counts as a text of its own kind; a null lang is the part ''. Rows without doc_id are audited like others, but have no
    smaller one, are no smaller one and have no label; rows that repeat doc_id and text aren't copies of each other. A document is good or
    toxic if any of its label rows says so. Other columns are ignored; without rows there are no parts.
    """
    n = len(names)
    labels = own_columns(labels, "doc_id", "quality", "toxic").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality").cast("int") == 1).alias("__good"), F.max(F.col("toxic").cast("int") == 1).alias("__toxic"))
    rows = flagged(documents).join(labels, "doc_id", "left").select("part", "mask", F.coalesce("__good", F.lit(False)).alias("good"), F.coalesce("__toxic", F.lit(False)).alias("toxic"))
    counts = prefix_counts(rows, n)
    steps = []
    for order in permutations(range(n)):
        steps += [("".join(names[i] for i in order), k + 1, sum(1 << f for f in order[:k]), f) for k, f in enumerate(order)]
    steps = documents.sparkSession.createDataFrame(steps, "filter_order string, step int, earlier int, filter int")
    # of the n! orders, so many have this set of filters, in any order, right before this filter
    before = F.bit_count("earlier")
    orders = F.factorial(before) * F.factorial(F.lit(n - 1) - before)
    own = W.partitionBy("part", "filter")
    only = lambda earlier: F.sum(F.when(F.col("earlier") == earlier, F.col("removed"))).over(own)
    others = F.lit((1 << n) - 1) - F.expr("shiftleft(1, filter)")
    counts = counts.select("*", only(F.lit(0)).alias("__fails"), only(others).alias("unique_fails"), F.sum(orders * F.col("removed")).over(own).alias("shapley"))
    return counts.join(F.broadcast(steps), ["earlier", "filter"]).select(  # n * n! fixed rows
        "part",
        "filter_order",
        "step",
        (F.col("left") - F.col("removed")).alias("kept"),
        "removed",
        (F.col("__fails") - F.col("removed")).alias("redundant"),
        "unique_fails",
        "good_lost",
        "toxic_lost",
        "shapley",
    )
