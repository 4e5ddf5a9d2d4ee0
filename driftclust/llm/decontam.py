"""Benchmark decontamination: exact hits of the pieces of each test item, verified by bit-parallel edit distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import cut, drop_cut, frugal, mix, own_columns

#: Bits of a filter for each entry, and the most that one has (64 MB): it is sent to all tasks. Beyond that it lets more through, but misses nothing.
BITS_PER_ENTRY, MOST_BITS = 64, 1 << 29
#: Bits that an entry sets.
PROBES = 3
#: Characters whose windows are hashed at once.
SLICE_CHARS = 1 << 20


def normal(text: str | None) -> str:
    """Lower case, runs of white space as one space, trimmed."""
    return " ".join(text.lower().split()) if text else ""


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """(offset, piece): ``budget`` + 1 pieces of about equal length. Whatever edits the budget allows, one piece stays whole."""
    edges = [len(item) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, item[a:b]) for a, b in zip(edges, edges[1:], strict=False) if b > a]


def best_match(pattern: str, text: str) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to any substring of the text, and the first end that has it.

    Bit-parallel (Myers 1999): bit i of the vertical deltas says how cell i of the column differs from cell i - 1.
    """
    m = len(pattern)
    where: dict[str, int] = {}
    for i, ch in enumerate(pattern):
        where[ch] = where.get(ch, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, now, best, end = full, 0, m, m, 0
    for j, ch in enumerate(text, 1):
        eq = where.get(ch, 0)
        zero = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = (minus | ~(zero | plus)) & full, plus & zero
        if up & top:
            now += 1
        elif down & top:
            now -= 1
            if now < best:
                best, end = now, j
        up, down = up << 1 & full, down << 1 & full
        plus, minus = (down | ~(zero | up)) & full, up & zero
    return best, end


def telling(item: str, text: str, start: int) -> bool:
    """Whether a short item at a place of a text is more than a word or two that any text may hold: the whole text, or three words or more on word
    borders."""
    end = start + len(item)
    if len(item) == len(text):
        return True
    borders = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return borders and item.count(" ") >= 2


# --- hashes of pieces ----------------------------------------------------------------------------------------------

_FACTOR = np.uint64(0xD1342543DE82EF95)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)


def _rolled(h: np.ndarray, codes: np.ndarray, at: np.ndarray, first: int, last: int) -> np.ndarray:
    """Polynomials of windows that begin ``at``, which have been taken up to character ``first``, taken on to character ``last``."""
    with np.errstate(over="ignore"):
        for i in range(first, last):
            h = h * _FACTOR + codes[at + i]
    return h


def _windows(codes: np.ndarray, size: int) -> np.ndarray:
    """Polynomials of all windows of ``size`` characters, put together from windows of 1, 2, 4 ... characters."""
    now, span, out, length = codes, 1, None, 0
    with np.errstate(over="ignore"):
        while True:
            power = np.uint64(pow(int(_FACTOR), span, 1 << 64))
            if size & span:
                n = len(codes) - length - span + 1
                out = now[:n] if out is None else out[:n] * power + now[length : length + n]
                length += span
            if length == size:
                return out
            n = len(codes) - 2 * span + 1
            now, span = now[:n] * power + now[span : span + n], 2 * span


def piece_head(piece: str) -> int:
    """The polynomial of the head of a piece."""
    return int(_windows(_codes(piece), len(piece))[0])


def piece_hash(piece: str) -> int:
    """A 64-bit hash of a piece."""
    return int(mix(_windows(_codes(piece), len(piece)), len(piece))[0])


def whole_only(item: str, short: int) -> bool:
    return len(item) < short and item.count(" ") < 2


def whole_hash(text: str) -> int:
    """The hash of a text that counts as a whole only."""
    return int(mix(np.array([piece_hash(text)], np.uint64), 99)[0])


def anchors(item: str, per_edit: int, short: int) -> list[tuple[int, int, int, int]]:
    """(hash, size, head, offset) of what leads to an item: of each of its pieces the hash, its size and the polynomial of its head, up to half of ``per_edit``
    characters; or, with size 0, the whole of an item that counts as a whole only."""
    if whole_only(item, short):
        h = whole_hash(item)
        return [(h, 0, h, 0)]
    return [(piece_hash(p), len(p), piece_head(p[: max(1, per_edit // 2)]), offset) for offset, p in pieces(item, len(item) // per_edit)]


class Bits:
    """A Bloom filter of 64-bit numbers."""

    def __init__(self, entries: int):
        self.shift = np.uint64(64 - min(MOST_BITS.bit_length() - 1, max(13, (entries * BITS_PER_ENTRY - 1).bit_length())))
        self.words = np.zeros(1 << (64 - int(self.shift) - 6), np.uint64)

    def places(self, x: np.ndarray, probe: int) -> np.ndarray:
        return mix(x, 40 + probe) >> self.shift

    def holds(self, x: np.ndarray) -> np.ndarray:
        """The places in ``x`` that may be in the filter."""
        at = None
        for probe in range(PROBES):
            place = self.places(x if at is None else x[at], probe)
            some = np.flatnonzero(self.words[(place >> np.uint64(6)).view(np.int64)] >> (place & np.uint64(63)) & np.uint64(1))
            at = some if at is None else at[some]
        return at

    @classmethod
    def of(cls, rows: DataFrame, column: str) -> Bits:
        """Of a column of numbers: tasks set bits in their own words, which are put together by OR."""
        made = cls(rows.count())

        @frugal
        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = batch.column(0).to_numpy().view(np.uint64)
                    place = np.unique(np.concatenate([made.places(x, probe) for probe in range(PROBES)]))
                    word, first = np.unique(place >> np.uint64(6), return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (place & np.uint64(63)), first).view(np.int64))], ["word", "bits"])

        found = rows.select(column).mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        made.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return made


def _items(per_edit: int, short: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [normal(t) for t in batch.column("text").to_pylist()]
            signed = lambda h: h - (1 << 64) if h >> 63 else h
            found = [[{"hash": signed(h), "size": size, "head": signed(head), "offset": offset} for h, size, head, offset in anchors(t, per_edit, short)] if t else [] for t in texts]
            kind = pa.list_(pa.struct([("hash", pa.int64()), ("size", pa.int32()), ("head", pa.int64()), ("offset", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.array(texts, pa.string()), pa.array(found, kind)], ["item_id", "item", "anchors"])

    return run


def hits_of(text: str, heads: Bits, bits: Bits, sizes: list[int], head: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hashes, places) of the windows of a normal text that may be pieces: those of ``sizes`` characters. Windows of ``head`` characters, or of a whole
    smaller size, are looked for first, and only where one may begin a piece are the sizes above taken."""
    for first in range(0, len(text), SLICE_CHARS):
        codes = _codes(text[first : first + SLICE_CHARS + max(sizes) - 1])
        for base in sorted({min(size, head) for size in sizes}):
            n = min(SLICE_CHARS, len(codes) - base + 1)
            if n < 1:
                continue
            rolled = _windows(codes, base)[:n]
            at = heads.holds(rolled)
            for size in sizes if len(at) else ():
                if min(size, head) == base:
                    here = at[at + size <= len(codes)]
                    found = mix(_rolled(rolled[here], codes, here, base, size), size)
                    some = bits.holds(found)
                    if len(some):
                        yield found[some], here[some] + first


def _hits(heads: Bits, bits: Bits, sizes: list[int], head: int, short: int):
    """Where a text has what may be a piece."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, hashes, places = [], [], []
            for row, text in enumerate(batch.column("text")):
                text = normal(text.as_py())
                found = list(hits_of(text, heads, bits, [s for s in sizes if s], head)) if text and max(sizes, default=0) else []
                if text and len(text) < short and 0 in sizes:
                    found.append((np.array([whole_hash(text)], np.uint64), np.zeros(1, np.int64)))
                for h, at in found:
                    rows.append(np.full(len(h), row))
                    hashes.append(h)
                    places.append(at)
            if rows:
                at = np.concatenate(rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(at)), pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places).astype(np.int64))], ["key", "hash", "place"])

    return run


# --- verification ----------------------------------------------------------------------------------------------------


def telling(item: str, text: str, start: int) -> bool:
    """Whether a short item at a place of a text is more than a word or two that any text may hold: the whole text, or three words or more on word
    borders."""
    end = start + len(item)
    if len(item) == len(text):
        return True
    borders = (start == 0 or not text[start - 1].isalnum()) and (end == len(text) or not text[end].isalnum())
    return borders and item.count(" ") >= 2


def find(item: str, text: str, starts: list[int], budget: int, short: int) -> tuple[int, int] | None:
    """(distance, end) of the best place of an item in a text, if it is within the budget; ``starts`` are where its pieces say that it begins."""
    if len(item) < short:
        starts = [s for s in starts if s >= 0 and text.startswith(item, s) and telling(item, text, s)]
    starts = sorted(set(starts))
    best, at = None, 0
    while at < len(starts):  # windows that overlap are searched as one
        low = high = starts[at]
        while at < len(starts) and starts[at] <= high + 2 * budget + len(item):
            high = starts[at]
            at += 1
        low, high = max(0, low - budget), min(len(text), high + len(item) + budget)
        if high - low < len(item) - budget:
            continue
        distance, end = best_match(item, text[low:high])
        if distance <= budget and (best is None or distance < best[0]):
            best = (distance, low + end)
    return best


def _verify(per_edit: int, short: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for doc_id, text, items in zip(batch.column("doc_id").to_pylist(), batch.column("text"), batch.column("items")):
                text = normal(text.as_py())
                for c in items.as_py():
                    best = find(c["item"], text, c["starts"], len(c["item"]) // per_edit, short)
                    if best:
                        found.append((doc_id, c["item_id"], *best, len(c["item"])))
            columns = list(zip(*found, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance", "end", "item_chars"])

    return run


def _maybe(bits: Bits):
    """The rows whose key may be in a filter."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.take(pa.array(bits.holds(batch.column("key").to_numpy().view(np.uint64))))

    return run


def contaminations(documents: DataFrame, benchmark: DataFrame, per_edit: int = 20, short: int = 20) -> DataFrame:
    """Test items found in documents: doc_id, item_id, distance, end, item_chars; a row for each document row and item found in it.

    Texts are compared in lower case with white space runs as one space. An item is found where some part of the document is
    within an edit distance of one edit per ``per_edit`` characters of the item; ``distance`` is the least one and ``end`` where,
    in the document's normal text, the first such place ends. Whole documents are searched for every item. An item of fewer than ``short``
    characters says little: it counts without any edit only, as the whole text of a document or, if it has three words or more, on word borders.

    However many items there are, documents are read twice: once for windows whose hash may be that of a piece, by Bloom filters of the heads of
    all pieces and of the pieces, which have a fixed greatest size, and once for the texts that hold one. In between hits meet pieces in a join by hash; only texts with a piece are
    shuffled, each with its items, and verified. Hashes lead to candidates only, so that they collide changes nothing.

    Null or empty items are never found, null or empty texts hold none. Items that share an id are all sought. Null ids return as
    they are. Other columns are ignored.
    """
    docs = own_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.where("text IS NOT NULL").withColumn("key", F.xxhash64("doc_id", "text"))
    items = own_columns(benchmark, "item_id", "text").select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").distinct()
    items = cut(items.mapInArrow(_items(per_edit, short), "item_id long, item string, anchors array<struct<hash:long,size:int,head:long,offset:int>>").where("item <> ''").withColumn("item_key", F.xxhash64("item_id", "item")).dropDuplicates(["item_id", "item"]), "items")
    pieces_ = items.select("item_key", F.explode("anchors").alias("a")).select("item_key", "a.*")
    sizes = sorted(r[0] for r in pieces_.select("size").distinct().collect())  # per_edit or short at most
    heads, bits = (Bits.of(pieces_.select(c).distinct(), c) for c in ("head", "hash"))
    hits = keyed.select("key", "text").mapInArrow(_hits(heads, bits, sizes, max(1, per_edit // 2), short), "key long, hash long, place long")
    starts = hits.join(pieces_, "hash").groupBy("key", "item_key").agg(F.collect_set((F.col("place") - F.col("offset")).cast("int")).alias("starts"))
    texts = items.select("item_key", "item_id", "item")
    candidates = starts.join(texts, "item_key").groupBy("key").agg(F.collect_list(F.struct("item_id", "item", "starts")).alias("items"))
    candidates = cut(candidates, "item-hits")
    drop_cut(items)
    held = keyed.mapInArrow(_maybe(Bits.of(candidates, "key")), keyed.schema)
    return held.join(candidates, "key").select("doc_id", "text", "items").mapInArrow(_verify(per_edit, short), "doc_id long, item_id long, distance long, end long, item_chars long")
