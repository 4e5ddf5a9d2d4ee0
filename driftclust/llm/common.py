"""Shared pieces of the text operators: scratch tables, bounded slices of Arrow batches, exact 64-bit hashing of words."""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftclust.session import shared_folder, spread

#: Bytes of text that one numpy pass holds at once; its temporaries take about 40 times as much.
SLICE_BYTES = 1 << 18
#: Bytes of rows in an Arrow batch; a single row may have more.
BATCH_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: the lineage ends there and lost executors cost no recomputation. The shuffle
    files that led to it, which nothing reads any more, are deleted."""
    spark, path, key = df.sparkSession, f"{shared_folder(df.sparkSession)}/{what}-{uuid.uuid4().hex}", "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop_cut(df: DataFrame) -> None:
    """Delete the files of a frame made by ``cut`` that no later plan reads."""
    spark = df.sparkSession
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(file)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's limit on the bytes of an Arrow batch to BATCH_BYTES, where it is higher: rows may be long, and a batch stands in
    the executor's memory several times over, in the JVM and in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key, "67108864b").rstrip("b") or 0) > BATCH_BYTES or spark.conf.get(key, "").startswith("-"):
        spark.conf.set(key, f"{BATCH_BYTES}b")


def own_columns(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, absent ones as null strings: other columns may have any name. A small table is dealt to all cores."""
    bound_batches(df.sparkSession)
    have = set(df.columns)
    return spread(df.select(*(F.col(f"`{n}`") if n in have else F.lit(None).cast("string").alias(n) for n in names)))


def packed(df: DataFrame, *keys: str) -> tuple[DataFrame, Callable[[str], Column]]:
    """``df`` with its ``keys`` as they are and all other columns in one, so that an operator's own columns clash with none; and what gives a
    column back by its name."""
    quoted = lambda c: F.col(f"`{c.replace('`', '``')}`")
    rest = [c for c in df.columns if c not in keys]
    place = {c: f"c{i}" for i, c in enumerate(rest)}
    back = lambda c: quoted(c) if c in keys else F.col("__rest").getField(place[c]).alias(c)
    return df.select(*map(quoted, keys), F.struct(F.lit(0).alias("none"), *(quoted(c).alias(place[c]) for c in rest)).alias("__rest")), back


# --- Arrow batches -----------------------------------------------------------------------------------------------


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` over Arrow batches, giving what Arrow's pool has free back to the system after each result and at the end: an executor keeps more
    workers than it has cores, and those that wait would hold as much as they ever took."""

    @functools.wraps(run)
    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for made in run(batches):
                yield made
                del made
                pa.default_memory_pool().release_unused()
        finally:
            pa.default_memory_pool().release_unused()

    return held


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them; a null is an empty text."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if offsets else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(ends) > 1 else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def runs(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` bytes each, one row at least."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


# --- words and their hashes --------------------------------------------------------------------------------------

_MASK = (1 << 64) - 1
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits all depend on all input bits (the finaliser of splitmix64)."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64) + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & _MASK)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


_BASE = 0xD1342543DE82EF95
_BYTE = mix(np.arange(256, dtype=np.uint64), 77)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, SLICE_BYTES + (1 << 16)) + 1
        _POWERS[:] = []
        for b in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            _POWERS.append(np.multiply.accumulate(p))
    return _POWERS[0], _POWERS[1]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of ``data``: the polynomial of its bytes, mixed. Equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    power, inverse = _powers(len(data) + 1)
    sums = np.empty(len(data) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_BYTE[data] * power[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words ``[^\\x20\\x09-\\x0D]+`` of each row, and how many words each row has."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def word_hashes(column: pa.Array, lower: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, word hashes of each row) for slices of a column. A row longer than a slice is cut at white space and put together again."""
    data, offsets = utf8(column)
    for a, b in runs(offsets):
        base, stop = int(offsets[a]), int(offsets[b])
        if stop - base <= 2 * SLICE_BYTES:
            part = data[base:stop]
            part = LOWER[part] if lower else part
            starts, ends, counts = word_spans(part, offsets[a : b + 1] - base)
            yield a, np.split(span_hashes(part, starts, ends), np.cumsum(counts)[:-1])
            continue
        found, at = [], base  # one row here
        while at < stop:
            to = min(at + SLICE_BYTES, stop)
            while to < stop and not SPACE[data[to : to + 4096]].any():
                to = min(to + 4096, stop)
            if to < stop:
                to += int(np.argmax(SPACE[data[to : to + 4096]]))
            part = LOWER[data[at:to]] if lower else data[at:to]
            starts, ends, _ = word_spans(part, np.array([0, len(part)]))
            found.append(span_hashes(part, starts, ends))
            at = to
        yield a, [np.concatenate(found)]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the runs of ``k`` words in order, repeats included; of fewer words, the whole sequence as one; of none, nothing."""
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    size = min(k, n)
    with np.errstate(over="ignore"):
        out = np.zeros(n - size + 1, np.uint64)
        for i in range(size):
            out = mix(out + words[i : n - size + 1 + i] * np.uint64(2 * i + 3), size)
    return out
