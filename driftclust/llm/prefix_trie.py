"""Trie of the turns that conversations share, as a compressed (Patricia) tree over their sorted sequences."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.taskcontext import TaskContext

from driftclust.llm.common import cut, own_columns

#: A turn in a sequence: the MD5 of role and text, then the words of the text in 4 bytes. Bytes of sequences sort as the sequences do.
TURN = 20
#: Leading turns of another conversation that a rebuilt one may begin with.
HEAD = 3
#: Conversations whose ids are joined before they are hashed: as many as share all but these bits of their id.
CELL_BITS = 12
#: Nodes in an Arrow batch of results.
BATCH_NODES = 20_000

_NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NO_ENDS = hashlib.sha256().hexdigest()


# --- sequences -----------------------------------------------------------------------------------------------------


def _rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations in the order (base, not the base itself, conv_id, turn, ...), one row each with its rebuilt sequence. What is held are the first
    turns of the base and the slim turns of one conversation."""
    base, head = None, b""
    conv, borrowed, own = None, 0, bytearray()
    out_ids, out_paths, size = [], [], 0

    def done() -> None:
        nonlocal head
        if conv is not None:
            out_ids.append(conv)
            out_paths.append(head[: borrowed * TURN] + bytes(own[borrowed * TURN :]) if conv != base else bytes(own))
            if conv == base:
                head = bytes(own[: HEAD * TURN])

    def flush() -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array(out_ids, pa.int64()), pa.array(out_paths, pa.binary())], ["conv_id", "path"])
        out_ids.clear()
        out_paths.clear()
        return batch

    for batch in batches:
        for b, c, h, turn in zip(*(batch.column(n).to_pylist() for n in ("base", "conv_id", "borrowed", "entry"))):
            if c != conv:
                done()
                size += len(own)
                if size > 1 << 22:
                    yield flush()
                    size = 0
                if b != base:
                    base, head = b, b""
                conv, borrowed, own = c, h, bytearray()
            own += turn
    done()
    if out_ids:
        yield flush()


def rebuilt_sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, path): each conversation with its first h turns replaced by those of conversation conv_id - conv_id % 20, h = crc32(conv_id) % 4; a
    path is its turns, TURN bytes each. A turn is shuffled as those bytes, its texts stay where they are."""
    rows = own_columns(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    words = F.unhex(F.lpad(F.hex(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))), 8, "0"))
    base = F.col("conv_id") - F.col("conv_id") % 20
    slim = rows.where("conv_id IS NOT NULL").select(base.alias("base"), "conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 4).cast("int").alias("borrowed"), "turn", "role", F.concat(key, words).alias("entry"))
    slim = slim.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.asc_nulls_first("turn"), "role", "entry")
    return slim.select("base", "conv_id", "borrowed", "entry").mapInArrow(_rebuild, "conv_id long, path binary")


def common_turns(a: bytes, b: bytes) -> int:
    """How many leading turns two sequences share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // TURN


# --- the compressed tree -------------------------------------------------------------------------------------------


class Point:
    """A branch, end or leaf of the compressed tree: its depth, and sums over what has been seen of its subtree."""

    __slots__ = ("depth", "first", "convs", "children", "leaves", "saved", "ends")

    def __init__(self, depth: int):
        self.depth, self.first, self.convs, self.children, self.leaves, self.saved, self.ends = depth, None, 0, 0, 0, 0, None

    def sums(self) -> list:
        return [self.depth, -1 if self.first is None else self.first, self.convs, self.children, self.leaves, self.saved]

    def take(self, first: int | None, convs: int, leaves: int, saved: int, children: int) -> None:
        if first is not None and (self.first is None or first < self.first):
            self.first = first
        self.convs, self.leaves, self.saved, self.children = self.convs + convs, self.leaves + leaves, self.saved + saved, self.children + children


class Nodes:
    """Finished nodes, on their way out. ``key`` names a point that has children, ``above`` the point over the top of an edge."""

    def __init__(self):
        self.rows: list[tuple] = []

    def edge(self, path: bytes, above: int, point: Point) -> int:
        """Add the nodes of the edge that ends in a finished ``point`` under a point at depth ``above``: those inside have the point's conversations and a
        single child, so the tokens they save are sums over suffixes of the edge. Returns what the whole edge saves."""
        words = np.frombuffer(path[above * TURN : point.depth * TURN], np.dtype([("key", "S16"), ("n", ">u4")]))["n"].tolist()
        leaves, saved = point.leaves if point.children else 1, point.saved
        top = above + 1
        for depth in range(point.depth, above, -1):
            saved += (point.convs - 1) * words[depth - top]
            bottom = depth == point.depth
            key = hashlib.md5(path[: depth * TURN]).digest() if bottom and point.children else None
            over = hashlib.md5(path[: above * TURN]).digest() if depth == top else None
            self.rows.append((point.first, depth, point.convs, point.children if bottom else 1, leaves, saved, (point.ends or _NO_ENDS) if bottom else _NO_ENDS, key, over))
        return saved

    def root(self, point: Point) -> None:
        self.rows.append((point.first, 0, point.convs, point.children, point.leaves if point.children else 1, point.saved, point.ends or _NO_ENDS, hashlib.md5(b"").digest(), None))

    def flush(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [()] * 9
        self.rows = []
        kinds = [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]
        arrays = [pa.array(list(c), t) for c, t in zip(columns, kinds)]
        n = len(arrays[0])
        arrays += [pa.nulls(n, t) for t in (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(arrays, _COLUMNS)


_COLUMNS = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "key", "above", "part", "path_first", "path_last", "before", "after", "ends"]
_RAW = "conv_id long, depth long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, key binary, above binary, part int, path_first binary, path_last binary, before binary, after binary, ends array<string>"


def _sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, int, int, str]]:
    """(path, first conversation, conversations, digest of their ids) of each distinct sequence; the ids come in pieces in their order."""
    path, first, n, digest = None, None, 0, hashlib.sha256()
    for batch in batches:
        for p, f, k, ids in zip(*(batch.column(c).to_pylist() for c in ("path", "first", "n", "ids"))):
            if p != path:
                if path is not None:
                    yield path, first, n, digest.hexdigest()
                path, first, n, digest = p, f, 0, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
            first, n = min(first, f), n + k
    if path is not None:
        yield path, first, n, digest.hexdigest()


def _close(stack: list[Point], down_to: int, path: bytes, nodes: Nodes, least: int) -> None:
    """Finish the points of ``path`` on the stack that are deeper than ``down_to``, down to index ``least``; where none stands at that depth, two sequences
    part there, and a branch is made."""
    while len(stack) > least and stack[-1].depth > down_to:
        point = stack.pop()
        if stack[-1].depth < down_to:
            stack.append(Point(down_to))
        above = stack[-1]
        saved = nodes.edge(path, above.depth, point)
        above.take(point.first, point.convs, point.leaves if point.children else 1, saved, 1)


def _grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The compressed tree of a range of sorted sequences. Points that the range's first or last sequence runs through may go on in the ranges beside
    it: they are not finished here, but leave as sums, in one row with both sequences."""
    nodes, before, stack = Nodes(), [], []
    path = first_path = None
    for after, first, n, ends in _sequences(batches):
        if path is None:
            first_path, stack = after, [Point(len(after) // TURN)]
        else:
            shared = common_turns(path, after)
            if shared < stack[0].depth:  # the lowest point here lies on the first sequence: it may have begun before this range
                _close(stack, stack[0].depth, path, nodes, 1)
                before.append(stack.pop())
                stack.append(Point(shared))
            else:
                _close(stack, shared, path, nodes, 1)
            stack.append(Point(len(after) // TURN))  # the later of two sequences is never a beginning of the earlier
        point, path = stack[-1], after
        point.take(first, n, 0, 0, 0)
        point.ends = ends
        if len(nodes.rows) >= BATCH_NODES:
            yield nodes.flush()
    if path is None:
        return
    if nodes.rows:
        yield nodes.flush()
    left = before + stack[:1]
    pack = lambda points: np.array([p.sums() for p in points], np.int64).tobytes()
    yield pa.RecordBatch.from_arrays(
        [pa.nulls(1, t) for t in [pa.int64()] * 6 + [pa.string(), pa.binary(), pa.binary()]]
        + [pa.array([TaskContext.get().partitionId()], pa.int32()), *(pa.array([x], pa.binary()) for x in (first_path, path, pack(left), pack(stack[1:]))), pa.array([[p.ends for p in left + stack[1:]]], pa.list_(pa.string()))],
        _COLUMNS,
    )


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Put the sums of all ranges, in their order, together: a point at a depth belongs to the last open one at that depth, if the sequences share it."""
    nodes, stack, path = Nodes(), [Point(0)], b""
    for batch in batches:
        for row in batch.to_pylist():
            left, right = (np.frombuffer(row[c], np.int64).reshape(-1, 6).tolist() for c in ("before", "after"))
            parts = [(row["path_first"], p) for p in left] + [(row["path_last"], p) for p in right]
            for (own, (depth, first, convs, children, leaves, saved)), ends in zip(parts, row["ends"]):
                shared = min(common_turns(path, own), depth)
                _close(stack, shared, path, nodes, 1)
                for d in (shared, depth):
                    if stack[-1].depth < d:
                        stack.append(Point(d))
                point, path = stack[-1], own[: depth * TURN]
                point.take(first if convs else None, convs, leaves, saved, children)
                point.ends = ends or point.ends
        if len(nodes.rows) >= BATCH_NODES:
            yield nodes.flush()
    _close(stack, 0, path, nodes, 1)
    if stack[0].convs:
        nodes.root(stack[0])
    if nodes.rows:
        yield nodes.flush()


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """A row for each node of the trie of rebuilt conversations (``rebuilt_sequences``): each distinct sequence of first turns, role and text, from the
    root without turns. conv_id is the smallest conversation that begins so, with depth its name; parent_conv_id that of the node above (root:
    null); n_convs conversations begin so; n_children; n_leaves childless nodes in the subtree, itself included; saved_tokens, for all nodes of the subtree
    (n_convs - 1) times the words of the last text; ends_sha256 the digest of the ids, in order and joined by commas, of those that end here.

    Distinct sequences are sorted in ranges; where neighbours part is a branch, and branches, ends and leaves are all points there are: a stack
    makes them in one pass over a range, with the nodes between two points when the lower is finished. Points on a range's first and last sequence leave as
    sums, two short lists a range, which one task joins in the order of the ranges. Of a frequent sequence only ids travel, in pieces of
    up to 4,096; they are hashed piece by piece, since SHA-256 has one order. The name of a node's parent is joined at the top of each edge.

    Turns are ordered by turn, nulls first, and then by role and the MD5 of role and text; null roles and texts are empty. Rows without
    conv_id belong to no conversation. Remainders have the sign of the id, as in SQL. A conversation that has fewer turns than it borrows and whose
    base is absent has none and ends at the root. Without conversations there is no root. A conversation's turns stand in one row, 20 bytes each. Other
    columns are ignored.
    """
    sequences = rebuilt_sequences(conversations)
    piece = F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    pieces = sequences.groupBy("path", F.shiftright("conv_id", CELL_BITS).alias("cell")).agg(F.min("conv_id").alias("first"), F.count("*").alias("n"), piece.alias("ids"))
    sorted_pieces = pieces.repartitionByRange("path").sortWithinPartitions("path", "cell").select("path", "first", "n", "ids")
    grown = cut(sorted_pieces.mapInArrow(_grow, _RAW), "trie")
    spines = grown.where("part IS NOT NULL").repartition(1).sortWithinPartitions("part").select("path_first", "path_last", "before", "after", "ends")
    joined = cut(spines.mapInArrow(_join, _RAW), "trie-spines")
    nodes = grown.where("part IS NULL").unionAll(joined)
    above = nodes.where("key IS NOT NULL").select(F.col("key").alias("above"), F.col("conv_id").alias("parent"))
    tops = nodes.where("above IS NOT NULL").join(above, "above", "left")
    shape = lambda df, parent: df.select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    inside = nodes.where("above IS NULL")
    return shape(tops, F.col("parent")).unionAll(shape(inside, F.when(F.col("depth") > 0, F.col("conv_id"))))
