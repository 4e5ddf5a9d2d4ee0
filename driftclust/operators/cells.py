"""Unit vectors in cells around centres: an inverted-list index for nearest neighbours, exact or approximate, and a join by least cosine.

Rows meet in equi-joins on cells, packed into blocks, and are compared by matrix products in Arrow batches. What a cell may hold for a row is
bounded by the triangle inequality on angles: a vector at angle x from a centre is at least x - r away from all vectors within r of the centre.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from driftclust.operators.scoring import matrix
from driftclust.session import settled, spread

#: Cells at most, so that the centres sent to all tasks take 4,096 vectors at most.
MOST_CELLS = 4096
#: Vectors for each cell that the centres are learnt from.
PER_CELL = 64
#: Rows of a block; of a pair of blocks only the products of their rows are made.
BLOCK = 512
#: Vectors that one cell serves as well as many.
FEW = 1024
#: Rows that a task holds against all centres at once.
SEEN = 128
#: Bytes of the rows that stay in a task while others are held against them, and products made at once.
STAYING, PRODUCTS = 16 << 20, 1 << 20
#: What rounding may do to an angle.
SLACK = 1e-5


def unit(x: np.ndarray) -> np.ndarray:
    """Rows at length 1; zeros stay."""
    length = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, length, out=np.zeros_like(x, np.float64), where=length > 0)


def _sums(centres: np.ndarray):
    """Of the rows nearest to each centre the sums by coordinate."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(centres.shape)
        for batch in batches:
            x = unit(matrix(batch.column("embedding"), centres.shape[1]))
            np.add.at(sums, np.argmax(x @ centres.T, axis=1) if len(x) else np.zeros(0, int), x)
        cell, dim = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(dim, pa.int32()), pa.array(sums[cell, dim])], ["cell", "dim", "x"])

    return run


def learn_centres(vectors: DataFrame, n_cells: int | None = None, seed: int = 42, rounds: int = 6, per_cell: int = PER_CELL) -> np.ndarray:
    """Centres of cells by spherical k-means over ``vectors`` (embedding): n_cells rows at length 1, twice the root of the rows if not said (or one, for
    FEW rows), MOST_CELLS at most. Learnt from about ``per_cell`` vectors a cell, drawn at random; each round sums by cell and coordinate in tasks, so that the driver
    gets centres only. A cell that no vector is nearest to keeps its centre. Without vectors there are no centres."""
    vectors = vectors.select("embedding").where("embedding IS NOT NULL")
    n = vectors.count()
    if not n:
        return np.zeros((0, 1))
    cells = min(MOST_CELLS, max(1, n_cells or (1 if n <= FEW else int(2 * n**0.5))), n)
    order = F.xxhash64(F.lit(seed), "embedding")
    sample = settled(vectors.where(F.rand(seed) < cells * per_cell / n), "cells-sample") if n > cells * per_cell else vectors
    first = sample.select("embedding").distinct().orderBy(order, "embedding").limit(cells).toArrow()
    flat = np.asarray(first.column("embedding").combine_chunks().flatten(), np.float64)
    centres = unit(flat.reshape(first.num_rows, -1))
    for _ in range(rounds if len(centres) > 1 else 0):
        found = spread(sample).mapInArrow(_sums(centres), "cell int, dim int, x double").groupBy("cell", "dim").agg(F.sum("x").alias("x")).toArrow()
        moved = np.zeros(centres.shape)
        moved[found.column("cell").to_numpy(), found.column("dim").to_numpy()] = found.column("x").to_numpy()
        centres = np.where((moved != 0).any(axis=1, keepdims=True), unit(moved), centres)
    return centres


def _map(rows: DataFrame, add: list[StructField], f: Callable[[pa.RecordBatch], tuple[np.ndarray, list[np.ndarray]]]) -> DataFrame:
    """``rows`` with further columns: ``f`` says which rows of a batch to repeat, and the new values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in (batch.slice(at, SEEN) for batch in batches for at in range(0, batch.num_rows, SEEN)):
            at, values = f(part)
            taken = part.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, *(pa.array(v, t) for v, t in zip(values, kinds))], names)

    kinds = [pa.int32() if isinstance(s.dataType, IntegerType) else pa.float64() for s in add]
    names = [*rows.columns, *(s.name for s in add)]
    return rows.mapInArrow(run, StructType([*rows.schema.fields, *add]))


def _angles(batch: pa.RecordBatch, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit(matrix(batch.column("embedding"), centres.shape[1])) @ centres.T, -1, 1))


_CELL, _ANGLE = StructField("cell", IntegerType()), StructField("angle", DoubleType())


def in_cells(rows: DataFrame, centres: np.ndarray) -> DataFrame:
    """``rows`` with the cell of the nearest centre and the angle to it."""

    def place(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        angles = _angles(batch, centres)
        cell = np.argmin(angles, axis=1) if len(angles) else np.zeros(0, int)
        return np.arange(len(cell)), [cell, angles[np.arange(len(cell)), cell]]

    return _map(rows, [_CELL, _ANGLE], place)


def visiting(rows: DataFrame, centres: np.ndarray, radii: np.ndarray, probes: int | None = None, within: str | None = None, skip: int = 0) -> DataFrame:
    """``rows`` once for each cell they must look into: the ``probes`` nearest, or all that can hold a vector as near as the angle in column
    ``within``. Of these the ``skip`` nearest are left out. ``radii`` are the largest angles in each cell, below 0 where it is empty."""

    def visit(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
        angles = np.where(radii < 0, np.inf, _angles(batch, centres))
        order = np.argsort(angles, axis=1, kind="stable")
        rank = np.empty_like(order)
        np.put_along_axis(rank, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), axis=1)
        keep = np.isfinite(angles) & (rank >= skip)
        if probes is not None:
            keep &= rank < probes
        if within is not None:
            keep &= angles - radii <= np.asarray(batch.column(within), float)[:, None] + SLACK
        at, cell = np.nonzero(keep)
        return at, [cell]

    return _map(rows, [_CELL], visit)


def cell_sizes(placed: DataFrame, n_cells: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and largest angle (-1 if empty) of each cell: a row for each cell on the driver."""
    counts, radii = np.zeros(n_cells, np.int64), np.full(n_cells, -1.0)
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("r")).collect():
        counts[r.cell], radii[r.cell] = r.n, r.r
    return counts, radii


def blocks(rows: DataFrame, sizes: np.ndarray, name: str) -> DataFrame:
    """(cell, part, name): the rows of each cell, packed into as many parts as hold about BLOCK rows each, by hash."""
    fields = [c for c in rows.columns if c != "cell"]
    parts = rows.sparkSession.createDataFrame([(i, int(-(-n // BLOCK))) for i, n in enumerate(sizes.tolist()) if n], "cell int, parts int")
    dealt = rows.join(F.broadcast(parts), "cell").withColumn("part", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int"))
    return dealt.groupBy("cell", "part").agg(F.collect_list(F.struct(*fields)).alias(name)).select("cell", F.col("part").alias(f"{name}_part"), name)


def _counted(rows: DataFrame, n_cells: int) -> np.ndarray:
    counts = np.zeros(n_cells, np.int64)
    for r in rows.groupBy("cell").count().collect():
        counts[r.cell] = r["count"]
    return counts


def _products(keys: pa.Array, vectors: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Keys and vectors at length 1."""
    return keys, unit(matrix(vectors, len(vectors[0])))


def _top(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                left, right = batch.column("seekers")[i].values, batch.column("homes")[i].values
                right = right.take(pa.array(sorted(range(len(right)), key=lambda j, k=right.field("key").to_pylist(): tuple(k[j].values()))))
                (who, a), (whom, b) = (_products(x.field("key"), x.field("embedding")) for x in (left, right))
                far = -(a @ b.T)
                order = np.argsort(far, axis=1, kind="stable")[:, :n]
                at, col = np.repeat(np.arange(len(a)), order.shape[1]), order.ravel()
                yield pa.RecordBatch.from_arrays([who.take(pa.array(at)), whom.take(pa.array(col)), pa.array(-far[at, col])], ["item", "key", "sim"])

    return run


def _over(least: float, one_way: bool):
    """Over rows (block, seeks, key, embedding) in order of block and seeks: the pairs of those of a block that seek and those that stay. Those that stay are held,
    the others pass by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, homes, held = None, [], None
        for batch in batches:
            block, seeks = batch.column("block").to_numpy(), batch.column("seeks").to_numpy()
            edges = np.flatnonzero(np.diff(block) | np.diff(seeks)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(block)]):
                if a == b:
                    continue
                if block[a] != now:
                    now, homes, held = block[a], [], None
                if not seeks[a]:
                    homes.append(batch.slice(a, b - a))
                    continue
                if held is None:
                    whole = pa.Table.from_batches(homes).combine_chunks() if homes else None
                    held = _products(whole.column("key").combine_chunks(), whole.column("embedding").combine_chunks()) if homes else (None, np.zeros((0, 1)))
                    homes = []
                whom, y = held
                step = max(1, PRODUCTS // max(len(y), 1))
                for at in range(a, b if len(y) else a, step):
                    part = batch.slice(at, min(step, b - at))
                    who, x = _products(part.column("key"), part.column("embedding"))
                    sims = x @ y.T
                    row, col = np.nonzero(sims >= least)
                    if one_way and len(row):
                        keep = _before(who, whom)(row, col)
                        row, col = row[keep], col[keep]
                    yield pa.RecordBatch.from_arrays([who.take(pa.array(row)), whom.take(pa.array(col)), pa.array(sims[row, col])], ["item", "key", "sim"])

    return run


def _before(who: pa.StructArray, whom: pa.StructArray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Which pairs of two arrays of keys are in order."""
    if who.type.num_fields == 1 and pa.types.is_integer(who.type.field(0).type):
        left, right = who.field(0).to_numpy(), whom.field(0).to_numpy()
    else:
        keys = [[tuple(k.values()) for k in x.to_pylist()] for x in (who, whom)]
        rank = {k: i for i, k in enumerate(sorted(set(keys[0]) | set(keys[1])))}
        left, right = (np.array([rank[k] for k in x]) for x in keys)
    return lambda row, col: left[row] < right[col]


def _schema(item, key) -> StructType:
    return StructType([StructField("item", item), StructField("key", key), StructField("sim", DoubleType())])


def _vectors(df: DataFrame, *keys: str) -> DataFrame:
    """(key, embedding) of rows that have a vector other than null or zeros."""
    embedding = F.col("embedding").cast(ArrayType(DoubleType()))
    rows = df.select(F.struct(*keys).alias("key"), embedding.alias("embedding"))
    return rows.where(F.exists("embedding", lambda x: x != 0))


class CellIndex:
    """An index of rows (named key columns, embedding): every row lies in the cell of its nearest centre. Rows with a null or zero vector aren't found.

    The centres come from a bounded sample (``learn_centres``) or from an index before; all else covers every row.
    """

    def __init__(self, rows: DataFrame, *keys: str, centres: np.ndarray | None = None, n_cells: int | None = None, seed: int = 42):
        found = _vectors(rows, *keys)
        self.centres = learn_centres(found, n_cells, seed) if centres is None else centres
        self.homes = settled(in_cells(found, self.centres), "cells") if len(self.centres) else found.withColumn("cell", F.lit(0)).withColumn("angle", F.lit(0.0))
        self.sizes, self.radii = cell_sizes(self.homes, len(self.centres))

    def _meet(self, visits: DataFrame, kernel) -> DataFrame:
        n = len(self.centres)
        seekers = blocks(visits.select("key", "embedding", "cell"), _counted(visits, n), "seekers")
        homes = blocks(self.homes.select("key", "embedding", "cell"), self.sizes, "homes")
        both = seekers.join(homes, "cell").select("seekers", "homes")
        return both.mapInArrow(kernel, _schema(visits.schema["key"].dataType, self.homes.schema["key"].dataType))

    def nearest(self, items: DataFrame, n: int, *keys: str, probes: int | None = 8) -> DataFrame:
        """(item, key, sim, rank): the n rows most similar by cosine to each item, ties by key; item and key are structs of the key columns.

        With ``probes`` only the rows of so many cells are seen, those with the nearest centres. With None the answer is exact: the n-th best of
        the nearest cell says which other cells can hold a better one, and each item looks into those.
        """
        seekers = _vectors(items, *keys)
        empty = items.sparkSession.createDataFrame([], _schema(seekers.schema["key"].dataType, self.homes.schema["key"].dataType))
        found = empty
        if len(self.centres):
            found = self._meet(visiting(seekers, self.centres, self.radii, probes or 1), _top(n))
            if probes is None:
                found = settled(found, "cells-first")
                reach = found.groupBy("item").agg(F.count("*").alias("n"), F.sort_array(F.collect_list("sim"), asc=False).alias("s"))
                reach = reach.select(F.col("item").alias("key"), F.when(F.col("n") >= n, F.acos(F.greatest(F.least(F.get("s", F.lit(n - 1)), F.lit(1.0)), F.lit(-1.0)))).otherwise(F.lit(4.0)).alias("reach"))
                rest = visiting(seekers.join(reach, "key"), self.centres, self.radii, within="reach", skip=1)
                found = found.unionAll(self._meet(rest, _top(n)))
        order = W.partitionBy("item").orderBy(F.desc("sim"), "key")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= n)

    def probes_for(self, items: DataFrame, n: int, recall: float, *keys: str, sample: int = 200, seed: int = 42) -> int:
        """How many cells to probe so that of the n nearest rows a share ``recall`` is found: at how many cells' distance from the item they lie, measured exactly
        on the ``sample`` items with the smallest hashes."""
        drawn = settled(items.select(*keys, "embedding").orderBy(F.xxhash64(F.lit(seed), *keys), *keys).limit(sample), "cells-probe")
        near = self.nearest(drawn, n, *keys, probes=None).select("item", "key").join(self.homes.select("key", "cell"), "key")
        rows = near.join(_vectors(drawn, *keys).select(F.col("key").alias("item"), "embedding"), "item").select("embedding", "cell").toArrow()
        if not rows.num_rows:
            return 1
        batch = rows.combine_chunks().to_batches()[0]
        angles = np.where(self.radii < 0, np.inf, _angles(batch, self.centres))
        nearer = (angles < angles[np.arange(len(angles)), batch.column("cell").to_numpy()][:, None]).sum(axis=1)
        return int(np.sort(nearer)[min(len(nearer) - 1, int(np.ceil(recall * len(nearer))))]) + 1

    def alike(self, items: DataFrame, least: float, *keys: str, one_way: bool = False) -> DataFrame:
        """(item, key, sim) of all pairs with a cosine of ``least`` or more; exact. With ``one_way`` only pairs whose item comes before the key."""
        seekers = _vectors(items, *keys)
        if not len(self.centres):
            return items.sparkSession.createDataFrame([], _schema(seekers.schema["key"].dataType, self.homes.schema["key"].dataType))
        first, parts, n_blocks = self._packing(seekers.sparkSession.sparkContext.defaultParallelism)
        centres, radii, reach = self.centres, self.radii, float(np.arccos(np.clip(least, -1, 1))) + SLACK
        spans = [np.arange(a, a + n) for a, n in zip(first.tolist(), parts.tolist())]

        def visit(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
            seen = np.zeros((batch.num_rows, n_blocks), bool)
            near = _angles(batch, centres) - radii <= reach
            for cell in np.flatnonzero(near.any(axis=0) & (radii >= 0)).tolist():
                seen[np.ix_(near[:, cell], spans[cell])] = True
            row, block = np.nonzero(seen)
            return row, [block]

        def stay(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray]]:
            cell = batch.column("cell").to_numpy()
            return np.arange(len(cell)), [first[cell] + batch.column("dealt").to_numpy() % parts[cell]]

        block = [StructField("block", IntegerType())]
        homes = _map(self.homes.select("key", "embedding", "cell", F.pmod(F.xxhash64("key"), F.lit(1 << 30)).alias("dealt")), block, stay)
        rows = homes.select("block", F.lit(0).alias("seeks"), "key", "embedding").unionByName(_map(seekers, block, visit).select("block", F.lit(1).alias("seeks"), "key", "embedding"))
        met = rows.repartition(n_blocks, "block").sortWithinPartitions("block", "seeks")
        return met.mapInArrow(_over(least, one_way), _schema(seekers.schema["key"].dataType, self.homes.schema["key"].dataType))

    def _packing(self, cores: int) -> tuple[np.ndarray, np.ndarray, int]:
        """First block and number of blocks of each cell, and all blocks: neighbouring cells share one until it has its rows, which are so many that each core
        has about two blocks, between BLOCK and STAYING bytes; of a larger cell's blocks, each row is in one by its hash."""
        most = int(min(max(self.sizes.sum() // (2 * cores), BLOCK), max(STAYING // (8 * self.centres.shape[1]), 1)))
        first, parts, at, filled = np.zeros(len(self.sizes), np.int64), np.ones(len(self.sizes), np.int64), 0, 0
        axis = self.centres @ np.linalg.svd(self.centres - self.centres.mean(axis=0), full_matrices=False)[2][0]
        for cell in np.argsort(axis, kind="stable").tolist():
            n = int(self.sizes[cell])
            if filled and filled + n > most:
                at, filled = at + 1, 0
            parts[cell] = max(1, -(-n // most))
            first[cell], filled = at, filled + n
            if parts[cell] > 1:
                at, filled = at + int(parts[cell]), 0
        return first, parts, at + 1


def similar_pairs(rows: DataFrame, least: float, key: str, n_cells: int | None = None, seed: int = 42) -> DataFrame:
    """(a, b, cosine) of all pairs a < b of ``rows`` (key, embedding) with a cosine of ``least`` or more."""
    found = CellIndex(rows, key, n_cells=n_cells, seed=seed).alike(rows, least, key, one_way=True)
    return found.select(F.col(f"item.{key}").alias("a"), F.col(f"key.{key}").alias("b"), F.col("sim").alias("cosine"))
