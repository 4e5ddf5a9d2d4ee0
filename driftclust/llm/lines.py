"""Line dedup: documents that share runs of lines are aligned by patience diff, and common blocks go from the later one."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import SLICE_BYTES, SPACE, _powers, cut, drop_cut, mix, own_columns, runs, span_hashes, utf8

#: Holders of a run from which its first holder is sent to the holders instead of meeting them in one task. A larger table has a larger
#: limit, the rows divided by HOT_RUNS, so that at most HOT_RUNS runs are sent.
HOT_HOLDERS = 1024
HOT_RUNS = 100_000


def _trimmed(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the lines of all rows without white space around them, and how many lines each row has."""
    n = len(data)
    breaks = np.flatnonzero(data == 10)
    edges = np.sort(np.concatenate((breaks, offsets[1:])), kind="stable")  # ends of lines; a row's end comes once for the row
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    first = np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)
    ends = edges
    starts = np.concatenate(([0], edges[:-1] + 1)) if len(edges) else edges
    starts[first] = offsets[:-1]
    solid = np.flatnonzero(~SPACE[data])
    if not len(solid):
        return ends, ends, counts
    at, to = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    left = np.minimum(np.where(at < len(solid), solid[np.minimum(at, len(solid) - 1)], n), ends)
    right = np.maximum(np.where(to > 0, solid[np.maximum(to - 1, 0)] + 1, 0), left)
    return left, right, counts


def _words_within(data: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Words of each span: a word begins where white space, or the span's edge, is left of a byte that isn't."""
    inside = np.zeros(len(data) + 1, np.int32)
    np.cumsum(~SPACE[data] & np.concatenate(([True], SPACE[data[:-1]]))[: len(data)], out=inside[1:])
    opens = np.zeros(len(left), np.int64)
    some = (left < right) & (left > 0)
    opens[some] = ~SPACE[data[left[some] - 1]]
    return inside[right] - inside[left] + opens


def _long_line(line: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and words of a trimmed line of any length, slice by slice from its start; the hash of a line of one slice is that of ``span_hashes``."""
    found, words, open_word = np.zeros(1, np.uint64), 0, False
    for at in range(0, max(len(line), 1), SLICE_BYTES):
        part = np.frombuffer(line[at : at + SLICE_BYTES], np.uint8)
        one = np.array([0]), np.array([len(part)])
        h = span_hashes(part, *one)
        found = h if at == 0 else mix(h + found * np.uint64(3), 4)
        words += int(_words_within(part, *one)[0]) - (open_word and len(part) > 0 and not SPACE[part[0]])
        open_word = len(part) > 0 and not SPACE[part[-1]]
    return found, np.array([words])


def _long_row(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and words of the lines of one long text, in slices that end at line breaks."""
    hashes, words, at = [], [], 0
    while at <= len(row):
        to = min(at + SLICE_BYTES, len(row))
        if to < len(row):
            back = np.flatnonzero(row[at:to] == 10)
            if len(back):
                to = at + int(back[-1])
            else:
                while to < len(row) and not (row[to : to + SLICE_BYTES] == 10).any():
                    to = min(to + SLICE_BYTES, len(row))
                to += int(np.argmax(row[to : to + SLICE_BYTES] == 10)) if to < len(row) else 0
        part = row[at:to]
        if len(part) > SLICE_BYTES:  # a single line
            found = _long_line(part.tobytes().strip(b" \t\n\v\f\r"))
        else:
            left, right, _ = _trimmed(part, np.array([0, len(part)]))
            found = span_hashes(part, left, right), _words_within(part, left, right)
        hashes.append(found[0])
        words.append(found[1].astype(np.int64))
        at = to + 1
    return np.concatenate(hashes), np.concatenate(words)


def line_hashes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """(first row, hashes of the trimmed lines of each row, words of those lines) for slices of rows; blank lines have the hash of nothing."""
    for a, b in runs(offsets):
        part, ends = data[int(offsets[a]) : int(offsets[b])], offsets[a : b + 1] - offsets[a]
        if len(part) > SLICE_BYTES:  # one row here
            hashes, words = _long_row(part)
            yield a, [hashes], [words]
            continue
        left, right, counts = _trimmed(part, ends)
        cuts = np.cumsum(counts)[:-1]
        yield a, np.split(span_hashes(part, left, right), cuts), np.split(_words_within(part, left, right), cuts)


def _numbered(a: np.ndarray) -> list[tuple[int, int]]:
    """Each element with how many equal ones are left of it."""
    seen: dict[int, int] = {}
    out = []
    for x in a.tolist():
        seen[x] = seen.get(x, -1) + 1
        out.append((x, seen[x]))
    return out


def patience(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Matched positions of two sequences by patience diff: equal ends are matched; then the elements that are unique in both are matched
    in their longest increasing order, and the parts between them in the same way. Where no element is unique in both, equal ones are told apart by
    their count from the left."""
    out: list[tuple[int, int]] = []
    stack = [(0, len(a), 0, len(b))]
    while stack:
        a0, a1, b0, b1 = stack.pop()
        m = min(a1 - a0, b1 - b0)
        unlike = np.flatnonzero(a[a0 : a0 + m] != b[b0 : b0 + m])
        same = int(unlike[0]) if len(unlike) else m
        out += zip(range(a0, a0 + same), range(b0, b0 + same), strict=True)
        a0, b0, m = a0 + same, b0 + same, m - same
        if m:
            unlike = np.flatnonzero(a[a1 - m : a1] != b[b1 - m : b1])
            same = m - 1 - int(unlike[-1]) if len(unlike) else m
            out += zip(range(a1 - same, a1), range(b1 - same, b1), strict=True)
            a1, b1, m = a1 - same, b1 - same, m - same
        if not m:
            continue
        ua, ia, ca = np.unique(a[a0:a1], return_index=True, return_counts=True)
        ub, ib, cb = np.unique(b[b0:b1], return_index=True, return_counts=True)
        _, x, y = np.intersect1d(ua[ca == 1], ub[cb == 1], assume_unique=True, return_indices=True)
        pairs = sorted(zip((ia[ca == 1][x] + a0).tolist(), (ib[cb == 1][y] + b0).tolist(), strict=True))
        if not pairs:
            theirs = {key: b0 + j for j, key in enumerate(_numbered(b[b0:b1]))}
            pairs = [(a0 + i, theirs[key]) for i, key in enumerate(_numbered(a[a0:a1])) if key in theirs]
        if not pairs:
            continue
        tails: list[int] = []
        heads: list[int] = []
        back = [-1] * len(pairs)
        for k, (_, j) in enumerate(pairs):
            at = bisect_left(tails, j)
            back[k] = heads[at - 1] if at else -1
            tails[at : at + 1], heads[at : at + 1] = [j], [k]
        chain, k = [], heads[-1]
        while k >= 0:
            chain.append(pairs[k])
            k = back[k]
        last_a, last_b = a0, b0
        for i, j in reversed(chain):
            stack.append((last_a, i, last_b, j))
            out.append((i, j))
            last_a, last_b = i + 1, j + 1
        stack.append((last_a, a1, last_b, b1))
    return sorted(out)


def least_runs(hashes: np.ndarray, words: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of the runs of adjacent lines of a text that just reach ``least_words``, onward from each line and back from each line.

    Every line of a block of ``least_words`` words or more lies in such a run inside the block: the one onward from the block's first line,
    or, beyond its end, the one back from the line itself.
    """
    total = np.concatenate(([0], np.cumsum(words)))
    n = len(hashes)
    if total[-1] < least_words:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    onward = np.searchsorted(total, total[:-1] + least_words, "left")
    back = np.searchsorted(total, total[1:] - least_words, "right") - 1
    starts = np.concatenate((np.flatnonzero(onward <= n), back[back >= 0]))
    ends = np.concatenate((onward[onward <= n], np.flatnonzero(back >= 0) + 1))
    key = np.unique(starts * np.int64(n + 1) + ends)
    starts, ends = key // (n + 1), key % (n + 1)
    power, inverse = _powers(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(hashes, 5) * power[:n], dtype=np.uint64)))
    return mix((sums[ends] - sums[starts]) * inverse[starts], 6), starts, ends


def aligned(hashes: np.ndarray, words: np.ndarray, there: np.ndarray, starts: np.ndarray, ends: np.ndarray, least_words: int) -> list[tuple[int, int, int]]:
    """Blocks (start there, start here, lines) that a text has in common with an earlier one, of ``least_words`` words at least.

    ``there``, ``starts``, ``ends``: shared runs by their start in the earlier text and their span here, which name all lines of either text that
    can lie in a block. Those lines, in their order there and here, are aligned by patience diff, and only what is aligned is a block: adjacent
    lines aligned with adjacent ones. A run that this leaves out, since it is repeated or stands in another order, is aligned by itself.
    """
    shift = there - starts
    order = np.lexsort((starts, shift))
    shift, starts, ends = shift[order], starts[order], ends[order]
    reach = np.maximum.accumulate(ends + (np.cumsum(np.concatenate(([0], shift[1:] != shift[:-1]))) * (len(hashes) + 1)))
    opens = np.concatenate(([True], (shift[1:] != shift[:-1]) | (starts[1:] > reach[:-1] % (len(hashes) + 1))))
    at = np.flatnonzero(opens)
    shift, starts, ends = shift[at], starts[at], np.maximum.reduceat(ends, at)
    total = np.concatenate(([0], np.cumsum(words)))

    def blocks(which: slice) -> list[tuple[int, int, int]]:
        spread = np.concatenate([np.arange(a, b) for a, b in zip(starts[which], ends[which], strict=True)])
        earlier, first = np.unique(spread + np.repeat(shift[which], (ends - starts)[which]), return_index=True)
        here = np.unique(spread)
        pairs = patience(hashes[spread[first]], hashes[here])
        return [b for b in _unbroken([(int(earlier[i]), int(here[j])) for i, j in pairs]) if total[b[1] + b[2]] - total[b[1]] >= least_words]

    found, gone = blocks(slice(None)), np.zeros(len(hashes), bool)
    for _, line, n in found:
        gone[line : line + n] = True
    for i in range(len(starts)):
        if not gone[starts[i] : ends[i]].all():
            for block in blocks(slice(i, i + 1)):
                found.append(block)
                gone[block[1] : block[1] + block[2]] = True
    return found


def _unbroken(pairs: list[tuple[int, int]]) -> Iterator[tuple[int, int, int]]:
    at = 0
    while at < len(pairs):
        to = at + 1
        while to < len(pairs) and pairs[to] == (pairs[to - 1][0] + 1, pairs[to - 1][1] + 1):
            to += 1
        yield *pairs[at], to - at
        at = to


def _runs(least_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(row, *least_runs(h, w, least_words)) for first, hs, ws in line_hashes(*utf8(batch.column("text"))) for row, (h, w) in enumerate(zip(hs, ws, strict=True), first)]
            rows = np.repeat([f[0] for f in found], [len(f[1]) for f in found]).astype(np.int64)
            if len(rows):
                run, start, end = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(rows)), batch.column("text_key").take(pa.array(rows)), pa.array(np.ascontiguousarray(run).view(np.int64)), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
                    ["doc_id", "text_key", "run", "start", "end"],
                )

    return run


_BLOCK = pa.struct([("earlier", pa.int64()), ("earlier_line", pa.int32()), ("line", pa.int32()), ("lines", pa.int32())])


def _delete(least_words: int):
    def blocks_of(leads, hashes: np.ndarray, words: np.ndarray) -> tuple[list[tuple], np.ndarray]:
        first, there, start, end, holders = (np.asarray(leads.field(c)) for c in ("first", "there", "start", "end", "holders"))
        order = np.lexsort((first, holders))
        rarest = dict.fromkeys(first[order].tolist())  # documents by the rarest run shared with them
        found, gone = [], np.zeros(len(hashes), bool)
        for doc in rarest:
            mine = first == doc
            if all(gone[a:b].all() for a, b in zip(start[mine], end[mine], strict=True)):
                continue
            for block in aligned(hashes, words, there[mine].astype(np.int64), start[mine].astype(np.int64), end[mine].astype(np.int64), least_words):
                found.append((doc, *block))
                gone[block[1] : block[1] + block[2]] = True
        return found, gone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, leads = batch.column("text"), batch.column("leads")
            data, offsets = utf8(texts)
            total = np.add.reduceat(np.concatenate((data == 10, [False])), offsets[:-1], dtype=np.int64) if batch.num_rows else np.zeros(0, np.int64)
            total = np.where(np.diff(offsets) > 0, total, 0) + 1
            if texts.null_count:
                total[texts.is_null().to_numpy(zero_copy_only=False)] = 0
            some = np.flatnonzero(leads.is_valid().to_numpy(zero_copy_only=False))
            removed, blocks, changed = np.zeros(batch.num_rows, np.int64), [[] for _ in range(batch.num_rows)], {}
            for row in some.tolist():
                raw = data[offsets[row] : offsets[row + 1]]
                _, hashes, words = next(line_hashes(raw, np.array([0, len(raw)])))
                blocks[row], gone = blocks_of(leads[row].values, hashes[0], words[0])
                changed[row] = "\n".join(line for line, out in zip(texts[row].as_py().split("\n"), gone, strict=True) if not out)
                removed[row] = int(gone.sum())
            kept = texts if not changed else pa.array([changed[i] if i in changed else texts[i].as_py() for i in range(batch.num_rows)], pa.string())
            as_rows = [[dict(zip(("earlier", "earlier_line", "line", "lines"), b, strict=True)) for b in row] for row in blocks]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), kept, pa.array(total), pa.array(removed), pa.array(as_rows, pa.list_(_BLOCK))], ["doc_id", "text", "n_lines", "n_removed", "blocks"])

    return run


def _leads(found: DataFrame) -> DataFrame:
    """(doc_id, text_key, first, there, start, end, holders) for each run that an earlier document has too.

    First holders are found by partial aggregation. Runs of many holders, of which there are at most HOT_RUNS, are sent to the rows; the others
    meet their rows by the run.
    """
    first = cut(found.groupBy("run").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.max("doc_id").alias("last"), F.count("*").alias("holders")).where("f.doc_id < last").select("run", F.col("f.doc_id").alias("first"), F.col("f.start").alias("there"), "holders"), "run-holders")
    hot = first.where(F.col("holders") > max(HOT_HOLDERS, found.count() // HOT_RUNS))
    one = F.struct("first", "there", "holders")
    tagged = found.join(F.broadcast(hot.select("run", one.alias("hot"))), "run", "left")  # HOT_RUNS rows at most
    cold = tagged.where("hot is null").drop("hot").join(first.join(F.broadcast(hot.select("run")), "run", "left_anti").select("run", one.alias("hot")), "run")
    return tagged.where("hot is not null").unionByName(cold).where("doc_id > hot.first").select("doc_id", "text_key", "hot.first", "hot.there", "start", "end", "hot.holders")


def dedup_lines(documents: DataFrame, least_words: int = 20) -> DataFrame:
    """Texts without the blocks of lines that an earlier document has: doc_id, text, n_lines (before), n_removed, blocks (earlier document, its
    line, line here, lines; from 0); a row for each row.

    Lines are what ``\\n`` parts, compared without white space around them. What goes is each line that lies in a block, a run of adjacent
    lines with ``least_words`` words or more, which patience diff aligns with a document with a smaller doc_id: every line of such a run
    that the two share is in an alignment of them, the one of all their shared lines or, in another order or repeated, one of the run itself.

    Documents meet through the hashes of the runs of lines that just reach ``least_words``, and of such a run through its first holder. As every
    line of a block lies in such a run inside the block, whoever else holds it, no block of any pair is missed, and k holders give k - 1
    leads, not k squared. The runs name all lines of the earlier document that can lie in a block, and the later one holds them too; so
    positions alone travel, and the two are aligned where the later text is, first with the document behind the rarest run.

    A null text stays null, with 0 lines; an empty text is one empty line. Rows with a null doc_id return unchanged and are nobody's
    earlier document. Rows that share a doc_id aren't compared with each other; each is aligned with the same earlier documents.
    Other columns are ignored. A row with a text needs memory in proportion to its lines; its bytes are read in slices.
    """
    docs = own_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    keyed = docs.withColumn("text_key", F.xxhash64("text"))
    found = cut(keyed.where("doc_id is not null and text is not null").mapInArrow(_runs(least_words), "doc_id long, text_key long, run long, start int, end int"), "line-runs")
    leads = _leads(found).groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("first", "there", "start", "end", "holders")).alias("leads"))  # as many as the row has runs
    leads = cut(leads, "line-leads")
    drop_cut(found)
    return keyed.join(leads, ["doc_id", "text_key"], "left").select("doc_id", "text", "leads").mapInArrow(_delete(least_words), "doc_id long, text string, n_lines long, n_removed long, blocks array<struct<earlier:long,earlier_line:int,line:int,lines:int>>")
