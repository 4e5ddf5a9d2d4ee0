"""Density groups of any number of vectors, fitted together: each point meets all others in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftclust.operators.density import merge_tree, neighbours, principal_axes, projected, tree_labels
from driftclust.operators.forest import AGAIN, HOMES, LISTED, SEEKERS, Forest, Lists, exact, quantum
from driftclust.session import settled

_FOUND = "kind string, part int, pos binary, bound binary, w binary, d binary, q binary, state binary"
_ASKED = "kind string, part int, pos binary, bound binary, core binary, comp binary, state binary"


def _array(cell: pa.Scalar, kind: type, *shape: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), kind).reshape(*(shape or (-1,)))


def numbered(items: DataFrame) -> tuple[DataFrame, int]:
    """(pos, id, embedding) with positions from 0 in the order of seq, numbered in ranges, and the number of items."""
    ranges = items.select("seq", "id", "embedding").repartitionByRange("seq", "id").sortWithinPartitions("seq", "id")
    rows = settled(ranges.withColumn("at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("at", 33).cast("int")
    counts = sorted((r.part, r["count"]) for r in rows.groupBy(part.alias("part")).count().collect())
    starts, n = [], 0
    for p, count in counts:
        starts.append((p, n))
        n += count
    before = items.sparkSession.createDataFrame(starts, "part int, before long")
    placed = rows.withColumn("part", part).join(F.broadcast(before), "part")
    return placed.select((F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("pos"), "id", "embedding"), n


def _matrix(column: pa.Array) -> np.ndarray:
    column = column.cast(pa.list_(pa.float32()))
    return column.values.to_numpy(zero_copy_only=False)[column.offsets[0].as_py() : column.offsets[-1].as_py()].reshape(len(column), -1)


def _axes(points: DataFrame, n: int, components: int) -> tuple[np.ndarray | None, float]:
    """The principal axes that ``reduce`` would take, or none, and the greatest length of what is then grouped. Sums are made in tasks."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, longest = 0, 0.0
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding")).astype(np.float64)
                sums = x.sum(axis=0) if not rows else sums + x.sum(axis=0)
                rows, longest = rows + len(x), max(longest, float(np.sqrt((x * x).sum(axis=1)).max()))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array([sums.tobytes()], pa.binary()), pa.array([longest])], ["sums", "longest"])

    parts = points.select("embedding").mapInArrow(total, "sums binary, longest double").collect()
    mean = np.sum([np.frombuffer(r.sums) for r in parts], axis=0) / n
    if components < 2 or n < max(50, 3 * components) or 3 * components >= len(mean):
        return None, max(r.longest for r in parts)

    def squares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("embedding")).astype(np.float64) - mean
                out = x.T @ x if out is None else out + x.T @ x
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["squares"])

    found = None
    for r in points.select("embedding").mapInArrow(squares, "squares binary").collect():
        part = np.frombuffer(r.squares).reshape(len(mean), -1)
        found = part if found is None else found + part
    return principal_axes(found, components), 1.0


def _packs(points: DataFrame, axes: np.ndarray | None, unit: float, size: int) -> DataFrame:
    """(part, x): coordinates of ``size`` points each, in the order of their positions, in multiples of ``unit``."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos").combine_chunks()
        x = _matrix(table.column("embedding").chunk(0))
        x = x if axes is None else projected(x, axes)
        x = exact(x, unit).astype(np.float32)
        return pa.table({"part": pa.array([table.column("pos")[0].as_py() // size], pa.int32()), "x": pa.array([x.tobytes()], pa.binary())})

    return points.select("pos", "embedding").groupBy(F.floor(F.col("pos") / size).alias("pack")).applyInArrow(pack, "part int, x binary")


def _search(most: int, parts: int, width: int):
    """Over pairs of seekers and homes, seekers after seekers: their lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, lists, met = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                of = {name: batch.column(name)[i] for name in batch.schema.names}
                if of["part"].as_py() != now:
                    now, met, x = of["part"].as_py(), 0, _array(of["x"], np.float32, -1, width).astype(np.float64)
                    pos, limit = np.arange(now * SEEKERS, now * SEEKERS + len(x)), np.full(len(x), np.inf)
                    core, comp = np.zeros(len(x)), pos
                    if of["pos"].is_valid:
                        pos, limit, core, comp = (_array(of[c], kind) for c, kind in (("pos", np.int64), ("bound", np.float64), ("core", np.float64), ("comp", np.int64)))
                    lists = Lists(x[pos - now * SEEKERS], core, comp, limit, most)
                home, at = _array(of["home_x"], np.float32, -1, width).astype(np.float64), of["home"].as_py() * HOMES
                if of["home_comp"].is_valid:
                    lists.meet(at, home, _array(of["home_core"], np.float64), _array(of["home_comp"], np.int64))
                else:
                    lists.meet(at, home, np.zeros(len(home)), np.arange(at, at + len(home)))
                met += 1
                if met == parts:
                    cells = [a.tobytes() for a in (pos, limit, lists.w, lists.d, lists.q)]
                    yield pa.RecordBatch.from_arrays([pa.array(["found"]), pa.array([now], pa.int32()), *(pa.array([c], pa.binary()) for c in cells), pa.array([None], pa.binary())], ["kind", "part", "pos", "bound", "w", "d", "q", "state"])
        if lists is not None and met != parts:
            raise RuntimeError("seekers didn't meet all homes in one run")

    return run


def _advance(table: pa.Table) -> Forest:
    """The forest after what was found, from one row of the state before, if there is one, and all lists."""
    state = [c for c in table.column("state") if c.is_valid]
    rows = table.filter(pc.equal(table.column("kind"), "found"))
    pos, limit = (np.concatenate([_array(c, kind) for c in rows.column(name)]) for name, kind in (("pos", np.int64), ("bound", np.float64)))
    w, d, q = (np.concatenate([_array(c, kind) for c in rows.column(name)]).reshape(len(pos), -1) for name, kind in (("w", np.float64), ("d", np.float64), ("q", np.int64)))
    if state:
        forest = Forest.unpacked(state[0].as_py())
        forest.listed(pos, w, d, q, limit)
        return forest
    order = np.argsort(pos)
    return Forest.first(d[order], q[order], int(table.column("k")[0].as_py()))


def _grown(table: pa.Table) -> pa.Table:
    """Rows of kind ``state``; and, unless the tree is whole, ``seek`` and ``home``: who seeks again, how far, and the components of all."""
    forest = _advance(table)
    pos, limit = forest.grow()
    out = {name: [] for name in ("kind", "part", "pos", "bound", "core", "comp", "state")}

    def row(kind: str, part: int, *cells: np.ndarray | None, state: bytes | None = None) -> None:
        for name, value in zip(out, (kind, part, *(c if c is None else c.tobytes() for c in cells), state), strict=True):
            out[name].append(value)

    row("state", 0, None, None, None, None, state=forest.packed())
    if len(pos):
        for part in np.unique(pos // SEEKERS).tolist():
            own = pos // SEEKERS == part
            row("seek", part, pos[own], limit[own], forest.core[pos[own]], forest.comp[pos[own]])
        for part, at in enumerate(range(0, len(forest.comp), HOMES)):
            row("home", part, None, None, forest.core[at : at + HOMES], forest.comp[at : at + HOMES])
    kinds = {"kind": pa.string(), "part": pa.int32()}
    return pa.table({name: pa.array(values, kinds.get(name, pa.binary())) for name, values in out.items()})


def whole_groups(items: DataFrame, min_cluster_size: int, min_samples: int, components: int) -> DataFrame:
    """(id, label) of all items (id, seq, embedding), fitted together whatever their number; -1 is noise. The groups of ``density_labels``.

    Every point meets all others in tasks, once for the nearest, which give core distances, and again in rounds, for what the spanning tree must still know: points of
    small components seek nearest points outside. The tree itself, a few numbers for each point, grows in one task in linear memory, as does its hierarchy.
    """
    points, n = numbered(items)
    if n < max(2, min_cluster_size):
        return points.select("id", F.lit(-1).cast("long").alias("label"))
    axes, longest = _axes(points, n, components)
    unit, k = quantum(longest), neighbours(n, min_cluster_size, min_samples)
    width = axes.shape[1] if axes is not None else len(points.select("embedding").first().embedding)
    seekers, homes = (settled(_packs(points, axes, unit, size), what) for size, what in ((SEEKERS, "seekers"), (HOMES, "homes")))
    tasks, nothing = min(-(-n // SEEKERS), 4 * items.sparkSession.sparkContext.defaultParallelism), F.lit(None).cast("binary")
    asked, most = None, max(LISTED, k - 1)
    while True:
        if asked is None:
            seek = seekers.select("*", *(nothing.alias(c) for c in ("pos", "bound", "core", "comp")))
            home = homes.select(F.col("part").alias("home"), F.col("x").alias("home_x"), nothing.alias("home_core"), nothing.alias("home_comp"))
        else:
            seek = seekers.join(asked.where("kind = 'seek'").select("part", "pos", "bound", "core", "comp"), "part")
            known = asked.where("kind = 'home'").select("part", F.col("core").alias("home_core"), F.col("comp").alias("home_comp"))
            home = homes.join(known, "part").select(F.col("part").alias("home"), F.col("x").alias("home_x"), "home_core", "home_comp")
        pairs = seek.repartition(tasks).crossJoin(F.broadcast(home))
        found = pairs.mapInArrow(_search(most, -(-n // HOMES), width), _FOUND)
        if asked is not None:
            before = asked.where("kind = 'state'").select("kind", "part", "pos", "bound", *(nothing.alias(c) for c in ("w", "d", "q")), "state")
            found = found.unionByName(before)
        asked = settled(found.withColumn("k", F.lit(k)).groupBy("k").applyInArrow(_grown, _ASKED), "forest")
        most = AGAIN
        if not asked.where("kind = 'seek'").limit(1).count():
            break

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for state in batch.column("state"):
                labels = tree_labels(merge_tree(Forest.unpacked(state.as_py()).rooted(), n), n, min_cluster_size)
                for at in range(0, n, 1 << 16):
                    part = labels[at : at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part))), pa.array(part, pa.int64())], ["pos", "label"])

    labels = settled(asked.where("kind = 'state'").select("state").mapInArrow(named, "pos long, label long"), "labels")
    return points.select("pos", "id").join(labels, "pos").select("id", "label")
