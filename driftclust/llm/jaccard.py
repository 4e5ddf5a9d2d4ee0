"""N-gram Jaccard join with count vectors in R-trees.

A document's set holds its distinct word shingles. Shingles are hashed into groups; a document is indexed as the point of
its group counts, the overlap of two documents is at most the sum of the coordinate minima of their points, and pairs which
that bound allows are verified on the sets themselves.

One tree over all points of a corpus can't be held by one task, and in many dimensions a search would visit most of it. So
the points are first dealt into blocks in such a way that linked sets always meet: sets with a similarity of t differ in at
most d = floor(n (1 - t) / t) members, n the smaller size. The members are dealt by hash to groups, and of their first
d + 1 groups that aren't empty, in group order, one at least holds the same members in both. (Were it otherwise, each of the
d + 1 groups of the set whose list ends first would need a difference of its own.) The hash of a group's members names a block.
Each block is searched through an R-tree.

Hot groups: copies of a set are one node from the start. A block isn't searched for pairs that are linked already: first
each node joins the star of the block's least node that it shares most blocks with, a tree over the star's points tells whether the
bound allows a link with the centre, or else the best partner; then what is still apart is searched for the best partner by
bound in another component, and only what remains is searched in full, in chunks of bounded size.

Texts, points and sets are wide beside the keys that pick them. Each is picked by a Bloom filter of those keys where it lies, so
that only what may be needed is shuffled, whatever the size of the tables is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import cut, drop_cut, frugal, mix, own_columns, shingles, utf8, word_hashes  # noqa: F401
from driftclust.llm.components import components
from driftclust.llm.decontam import Bits
from driftclust.llm.rtree import CountTree

#: Coordinates of a point. The more, the closer the sum of minima comes to the overlap; a byte each where counts allow it.
GROUPS = 512
#: Sets below this size use one partition of the members for each number of differences, or single members.
SMALL = 64
#: Nodes of one side of a block that one task searches at once.
CHUNK = 2048
#: Partners of a node that its set is sent to together.
STAR = 256


def _as_int64(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def _group_hashes(members: np.ndarray, groups: int, salt: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the groups that aren't empty, in order: number, hash of the members; and the number of each member's group."""
    of = ((mix(members, salt) >> np.uint64(32)) * np.uint64(groups)) >> np.uint64(32)
    order = np.argsort(of, kind="stable")
    ranked = of[order]
    first = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1])))
    return ranked[first], np.add.reduceat(mix(members[order], salt + 1), first), of


def block_hashes(members: np.ndarray, num: int, den: int) -> np.ndarray:
    """The blocks of a set: any set within a Jaccard similarity of num / den shares one of them.

    Partitions of the members into few groups serve sets under SMALL; from there on groups grow with the set, in size classes
    that double, and a set just above a class joins the class below too. That a set fills too few groups for the argument above
    to hold has a probability below 1e-10, as hash collisions have.
    """
    n, spare = len(members), den - num
    if not n:
        return np.zeros(0, np.uint64)
    least = -(-n * num // den)  # of any set similar to this one
    found = []
    if least < SMALL:
        top = min(n, SMALL - 1) * spare // num + 1
        if 5 * spare >= num:  # many differences for the size: single members, the rarest by hash first
            found.append(np.sort(mix(members, 11))[: n * spare // num + 1])
        else:
            for groups in range(least * spare // num + 1, top + 1):
                number, hashes, _ = _group_hashes(members, groups, 13)
                full = np.zeros(groups, np.uint64)
                full[number.astype(np.int64)] = hashes
                found.append(mix(full + mix(np.arange(groups, dtype=np.uint64), 1000 + groups), 17))
    base = SMALL
    while base <= n:
        if least < 2 * base:
            rate = spare / num
            fill = next(x / 10 for x in range(100, 9, -1) if (1 - np.exp(-x / 10)) / (x / 10) >= 1.4 * rate or x == 10)
            groups = int(np.ceil(2 * base * den / num / fill))
            number, hashes, _ = _group_hashes(members, groups, 19)
            wanted = min(n, 2 * base - 1) * spare // num + 1
            found.append(mix(hashes[:wanted] + mix(number[:wanted] + np.uint64(base << 32), 23), 29))
        base *= 2
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _member_sets(batch: pa.RecordBatch, k: int, lower: bool) -> Iterator[tuple[int, np.ndarray]]:
    for first, rows in word_hashes(batch.column("text"), lower):
        for i, words in enumerate(rows):
            yield first + i, np.unique(shingles(words, k))


def _describe(k: int, lower: bool, num: int, den: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, fp_a, fp_b, blocks, points = [], [], [], [], []
            for _, members in _member_sets(batch, k, lower):
                sizes.append(len(members))
                fp_a.append(mix(members, 3).sum(dtype=np.uint64))
                fp_b.append(np.bitwise_xor.reduce(mix(members, 5)) if len(members) else np.uint64(0))
                blocks.append(_as_int64(block_hashes(members, num, den)))
                counts = np.bincount((mix(members, 7) >> np.uint64(55)).astype(np.int64), minlength=GROUPS)
                points.append(counts.astype(np.uint8 if counts.max() < 256 else np.uint32).tobytes())
            ends = np.concatenate(([0], np.cumsum([len(x) for x in blocks]))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(_as_int64(np.array(fp_a, np.uint64))),
                    pa.array(_as_int64(np.array(fp_b, np.uint64))),
                    pa.ListArray.from_arrays(ends, np.concatenate(blocks) if blocks else np.zeros(0, np.int64)),
                    pa.array(points, pa.binary()),
                ],
                ["doc_id", "n", "fp_a", "fp_b", "blocks", "point"],
            )

    return run


def _among(bits: Bits, column: str):
    """The rows whose ``column`` may be in a filter."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.take(pa.array(bits.holds(batch.column(column).to_numpy().view(np.uint64)), pa.int64()))

    return run


def _blocks_among(bits: Bits):
    """(node, block) of the blocks that may be in a filter, over rows with the blocks of each node."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("blocks")
            block = lists.flatten()
            at = bits.holds(block.to_numpy().view(np.uint64))
            row = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))[at]
            yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(row, pa.int64())), block.take(pa.array(at, pa.int64()))], ["node", "block"])

    return run


def _sets(k: int, lower: bool, among: Bits):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _among(among, "doc_id")(batches):
            ids, sets = [], []
            for row, members in _member_sets(batch, k, lower):
                ids.append(row)
                sets.append(members.tobytes())
                if len(ids) == 512:
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids)), pa.array(sets, pa.binary())], ["node", "members"])
                    ids, sets = [], []
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(sets, pa.binary())], ["node", "members"])

    return run


def _point(value: pa.Scalar) -> np.ndarray:
    """Counts by group."""
    raw = value.as_buffer()
    return np.frombuffer(raw, np.uint8 if len(raw) == GROUPS else np.uint32)


def _grouped(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The groups of rows with equal keys, of rows sorted by them; one is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for batch in batches:
        values = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(axis=1)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if b > a:
                if held and now != tuple(values[a]):
                    yield pa.Table.from_batches(held)
                    held = []
                now = tuple(values[a])
                held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _pairs(low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["low", "high"])


def _star_search(num: int, den: int):
    """Over rows sorted by (low, part), the points of a star and its centre: for each node the centre, if the tree finds it within the bound, or else the
    best partner by bound that the tree finds."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "low", "part"):
            centre = group.column("low")[0].as_py()
            node, size = group.column("node").to_numpy(), group.column("n").to_numpy()
            points = np.stack([_point(p) for p in group.column("point")])
            tree = CountTree(points, size)
            found = []
            (at,) = np.flatnonzero(node == centre)
            near, _ = tree.search(points[at], int(size[at]), num, den)  # the bound is the same from either side
            linked = np.zeros(len(node), bool)
            linked[near] = True
            for q in np.flatnonzero(node != centre):
                if linked[q]:
                    found.append((centre, node[q]))
                    continue
                hits, bound = tree.search(points[q], int(size[q]), num, den)
                others = hits != q
                if others.any():
                    hits, bound = hits[others], bound[others]
                    best = node[hits[np.argmax(2 * bound / (size[hits] + size[q]))]]
                    found.append((min(best, node[q]), max(best, node[q])))
            both = np.array(sorted(set(found)), np.int64).reshape(-1, 2)
            yield _pairs(both[:, 0], both[:, 1])

    return run


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    """Common members of two sorted sets."""
    small, large = (x, y) if len(x) < len(y) else (y, x)
    if not len(small):
        return 0
    at = np.searchsorted(large, small)
    return int(np.count_nonzero(large[np.minimum(at, len(large) - 1)] == small))


def _set(value: pa.Scalar) -> np.ndarray:
    return np.frombuffer(value.as_buffer(), np.uint64)


def _verify(num: int, den: int):
    """Over rows with the sets of both."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for a, b in zip(batch.column("members_low"), batch.column("members_high"), strict=True):
                x, y = _set(a), _set(b)
                both = _overlap(x, y)
                keep.append(den * both >= num * (len(x) + len(y) - both))
            yield batch.select(["low", "high"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verify_stars(num: int, den: int):
    """Over rows sorted by (low, part, high), of which the first, without a high, has the set of the low."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre = np.zeros(0, np.uint64)
        for batch in batches:
            low, high = [], []
            for c, h, m in zip(batch.column("low"), batch.column("high"), batch.column("members"), strict=True):
                members = _set(m)
                if not h.is_valid:
                    centre = members.copy()
                    continue
                both = _overlap(centre, members)
                if den * both >= num * (len(centre) + len(members) - both):
                    low.append(c.as_py())
                    high.append(h.as_py())
            yield _pairs(np.array(low, np.int64), np.array(high, np.int64))

    return run


def _search(num: int, den: int, best_only: bool):
    """Over rows sorted by (block, i, j): pairs of nodes in different components that the bound allows. side: 0 meets 1; 2 meets all."""

    def one(group: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        node, part, side, size = (group.column(c).to_numpy() for c in ("node", "component", "side", "n"))
        points = np.stack([_point(p) for p in group.column("point")])
        tree = CountTree(points, size)
        low, high = [], []
        for q in np.flatnonzero(side > 0):
            hits, bound = tree.search(points[q], int(size[q]), num, den)
            fits = (part[hits] != part[q]) & ((side[hits] == 0) if side[q] == 1 else True)
            hits, bound = hits[fits], bound[fits]
            if best_only and len(hits):
                hits = hits[[np.argmax(2 * bound / (size[hits] + size[q]))]]
            low.append(np.minimum(node[hits], node[q]))
            high.append(np.maximum(node[hits], node[q]))
        return np.concatenate(low or [np.zeros(0, np.int64)]), np.concatenate(high or [np.zeros(0, np.int64)])

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _grouped(batches, "block", "i", "j"):
            low, high = one(group)
            both = np.unique(np.stack([low, high], axis=1), axis=0) if len(low) else np.zeros((0, 2), np.int64)
            yield _pairs(both[:, 0], both[:, 1])

    return run


class _Join:
    def __init__(self, documents: DataFrame, k: int, num: int, den: int, lower: bool):
        self.docs = own_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        self.k, self.num, self.den, self.lower = k, num, den, lower

    def parts(self, pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
        """Nodes that are the low of more than ``most`` pairs, with the number of parts to deal these into; and the pairs with their part, null
        for other nodes."""
        large = cut(pairs.groupBy("low").agg(F.count("*").alias("pairs")).where(F.col("pairs") > most).select("low", F.ceil(F.col("pairs") / F.lit(most)).alias("parts")), "large-stars")
        return large, pairs.join(large, "low", "left").select("low", "high", F.expr("pmod(xxhash64(high), parts)").alias("part"))

    def stars(self, pairs: DataFrame) -> DataFrame:
        """Pairs (low, high) that the trees over the points of each star find: a star's nodes come once, its centre once for each CHUNK of them."""
        _, dealt = self.parts(pairs, CHUNK)
        dealt = dealt.select("low", F.coalesce("part", F.lit(0)).alias("part"), "high")
        nodes = dealt.select("low", "part", F.col("high").alias("node")).unionByName(dealt.select("low", "part", F.col("low").alias("node")).distinct())
        rows = nodes.join(self.points, "node").repartition("low", "part").sortWithinPartitions("low", "part")
        return rows.mapInArrow(_star_search(self.num, self.den), "low long, high long").distinct()

    def linked(self, pairs: DataFrame) -> DataFrame:
        """Of distinct pairs those whose sets reach the similarity. The set of a node with many partners is sent once for STAR of them."""
        nodes = pairs.select(F.explode(F.array("low", "high")).alias("node")).distinct()
        s = self.sets.mapInArrow(_among(Bits.of(nodes, "node"), "node"), self.sets.schema)
        large, dealt = self.parts(pairs, STAR)
        of = lambda rows, side: rows.join(s.select(F.col("node").alias(side), F.col("members").alias(f"members_{side}")), side)
        few = of(of(dealt.where("part is null").select("low", "high"), "low"), "high").mapInArrow(_verify(self.num, self.den), "low long, high long")
        if large.isEmpty():
            return few
        many = dealt.where("part is not null")
        centres = of(many.select("low", "part").distinct(), "low").select("low", "part", F.lit(None).cast("long").alias("high"), F.col("members_low").alias("members"))
        rows = centres.unionByName(of(many, "high").select("low", "part", "high", F.col("members_high").alias("members")))
        rows = rows.repartition("low", "part").sortWithinPartitions("low", "part", F.asc_nulls_first("high"))
        return few.unionAll(rows.mapInArrow(_verify_stars(self.num, self.den), "low long, high long"))

    def open_blocks(self, members: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Members of the blocks with their components, and the blocks that hold several. Blocks with the same nodes count once."""
        rows = members.join(labels, "node", "left").select("block", "node", "least", F.coalesce("component", "node").alias("component"))
        main = F.max(F.when(F.col("node") == F.col("least"), F.col("component")))
        found = rows.groupBy("block").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), main.alias("main"), F.count("*").alias("all"), F.sum(F.xxhash64("node").cast("decimal(38,0)")).alias("who")).where("lo < hi")
        return rows, cut(found.groupBy("all", "who").agg(F.min(F.struct("block", "main")).alias("b")).select("b.block", "b.main", "all"), "open-blocks")

    def apart(self, rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """Rows of the blocks that hold several components, dealt into chunks.

        A side 0 is the component of the block's least node, side 1 the others, which also meet each other.
        """
        rows = rows.join(blocks, "block").withColumn("home", F.col("component") == F.col("main"))
        count = rows.groupBy("block").agg(F.count_if("home").alias("homes"), F.count_if(~F.col("home")).alias("others"))
        chunks = lambda c: F.ceil(F.col(c) / F.lit(CHUNK)).cast("int")
        rows = rows.join(count, "block").select("block", "node", "component", "home", chunks("homes").alias("nh"), chunks("others").alias("no"))
        own = F.pmod(F.xxhash64("node"), F.when(F.col("home"), F.col("nh")).otherwise(F.col("no")).cast("long")).cast("int")
        rows = rows.withColumn("own", own)
        spread = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
        key = lambda i, j, side: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(side).cast("int").alias("side") if isinstance(side, int) else side.cast("int").alias("side"))
        of_home = F.transform(spread("no"), lambda j: key(F.col("own"), j, 0))
        of_other = F.concat(
            F.transform(spread("nh"), lambda i: key(i, F.col("own"), 1)),
            F.transform(spread("no"), lambda j: key(-1 - F.least(j, F.col("own")), F.greatest(j, F.col("own")), F.when(j == F.col("own"), 2).when(F.col("own") < j, 0).otherwise(1))),
        )
        dealt = rows.select("block", "node", "component", F.explode(F.when(F.col("home"), of_home).otherwise(of_other)).alias("t")).select("block", "node", "component", "t.*")
        return dealt.join(self.points, "node").select("block", "i", "j", "side", "node", "component", "n", "point")

    def search(self, rows: DataFrame, blocks: DataFrame, best_only: bool) -> DataFrame:
        rows = self.apart(rows, blocks).repartition("block", "i", "j").sortWithinPartitions("block", "i", "j")
        return rows.mapInArrow(_search(self.num, self.den, best_only), "low long, high long").distinct()

    def run(self) -> DataFrame:
        all_sets = cut(self.docs.mapInArrow(_describe(self.k, self.lower, self.num, self.den), "doc_id long, n long, fp_a long, fp_b long, blocks array<long>, point binary"), "shingle-sets")
        same = ["fp_a", "fp_b", "n"]
        nodes = cut(all_sets.where("doc_id is not null and n > 0").groupBy(*same).agg(F.min("doc_id").alias("doc_id")), "nodes")
        first = cut(all_sets.join(nodes, [*same, "doc_id"]).dropDuplicates([*same, "doc_id"]).select(F.col("doc_id").alias("node"), "n", "blocks", "point"), "shingle-nodes")
        slim = cut(all_sets.select("doc_id", *same), "set-names")
        drop_cut(all_sets)
        rows = first.select("node", F.explode("blocks").alias("block"))
        shared = cut(rows.groupBy("block").agg(F.count("*").alias("nodes")).where("nodes > 1").select("block"), "shared-names")  # most blocks have one node
        rows = first.select("node", "blocks").mapInArrow(_blocks_among(Bits.of(shared, "block")), "node long, block long")
        rows = cut(rows.join(shared, "block"), "shared-blocks")
        drop_cut(shared)
        members = cut(rows.join(rows.groupBy("block").agg(F.min("node").alias("least")), "block"), "block-members")
        drop_cut(rows)
        involved = Bits.of(members.select("node").distinct(), "node")
        self.points = cut(first.select("node", "n", "point").mapInArrow(_among(involved, "node"), "node long, n long, point binary"), "points")
        drop_cut(first)
        self.sets = cut(self.docs.where("doc_id is not null").mapInArrow(_sets(self.k, self.lower, involved), "node long, members binary"), "member-sets")

        votes = members.where("node != least").groupBy("node", "least").agg(F.count("*").alias("votes"))
        stars = votes.groupBy("node").agg(F.max(F.struct("votes", (-F.col("least")).alias("least"))).alias("best")).select((-F.col("best.least")).alias("low"), F.col("node").alias("high"))
        tried = cut(self.stars(stars), "tried-pairs")
        links = cut(self.linked(tried), "linked-pairs")
        labels = components(links)
        for best_only in (True, False):
            held, blocks = self.open_blocks(members, labels)
            if blocks.isEmpty():
                break
            more = cut(self.search(held, blocks, best_only).join(tried, ["low", "high"], "left_anti"), "tried-pairs")
            if more.isEmpty():
                continue
            tried, links = tried.unionAll(more), cut(links.unionAll(self.linked(more)), "linked-pairs")
            labels = components(links)
        named = nodes.select(*same, F.col("doc_id").alias("node")).join(labels, "node", "left").select(*same, F.coalesce("component", "node").alias("component"))
        drop_cut(members), drop_cut(self.sets), drop_cut(self.points)
        every = slim.join(named, same, "left")
        return every.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def jaccard_components(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100, lower: bool = True) -> DataFrame:
    """Classes of documents linked by similar sets of word shingles: doc_id, n_shingles, component_id, a row for each row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the whole text, A-Z lowered; a set holds the distinct runs of ``k`` words, of a text
    with fewer words the whole sequence as one. Documents link when den * intersection >= num * union; component_id is the
    smallest doc_id that links reach, its own included. Sets are held as 64-bit hashes.

    A null or empty text, or one of white space, has an empty set and links with nothing: its class is its own doc_id.
    A null doc_id can't name a class: n_shingles is counted, component_id is null and it links nothing. Repeated rows each
    return; rows that share a doc_id are one document, linked by any of their texts. Other columns are ignored.
    """
    return _Join(documents, k, num, den, lower).run()


def first_of_each(documents: DataFrame, k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """Documents without those that have a near copy with a smaller doc_id in their class; columns as before.

    Rows with a null doc_id stay. Rows that repeat the kept doc_id stay, as one document.
    """
    classes = jaccard_components(documents, k, num, den).where("doc_id != component_id").select(F.col("doc_id").alias("__dropped")).distinct()
    return documents.join(classes, documents["doc_id"] == classes["__dropped"], "left_anti")
