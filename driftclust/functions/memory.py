"""Vectors by content: each distinct text of a model is embedded once, whatever jobs, replays or trials it comes up in."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftclust.functions.embed import Embedder, embed_column
from driftclust.session import settled, spread

#: Bits of a filter for each key, and the most that one has (16 MB). Beyond that it lets more through, but misses none.
BITS_PER_KEY, MOST_BITS = 16, 1 << 27
#: Bits that a key sets.
PROBES = 4
_VECTORS = "key binary, embedding array<float>"


def text_key(text: Column) -> Column:
    """The first half of a text's SHA-256; a null text is an empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)), 1, 16)


class KeyFilter:
    """A Bloom filter of 16-byte keys: two halves of a key give PROBES places by double hashing."""

    def __init__(self, bits: int):
        self.bits = bits
        self.words = np.zeros(bits // 64, np.uint64)

    def places(self, keys: pa.Array) -> np.ndarray:
        raw = np.frombuffer(b"".join(keys.to_pylist()), "<u8").reshape(-1, 2)
        with np.errstate(over="ignore"):
            return np.stack([(raw[:, 0] + np.uint64(i) * (raw[:, 1] | np.uint64(1))) % np.uint64(self.bits) for i in range(PROBES)], 1)

    def holds(self, keys: pa.Array) -> np.ndarray:
        at = self.places(keys)
        return (self.words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).all(axis=1).astype(bool)

    @classmethod
    def of(cls, keys: DataFrame) -> KeyFilter:
        """Of the column ``key``. Tasks set bits in their own words, which are put together by OR; a filter's words come to the driver, not its keys."""
        bits = 1 << int(np.ceil(np.log2(max(keys.count() * BITS_PER_KEY, 1 << 13))))
        made = cls(min(bits, MOST_BITS))

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    own = np.unique(made.places(batch.column("key")))
                    word, first = np.unique(own >> np.uint64(6), return_index=True)
                    yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(np.bitwise_or.reduceat(np.uint64(1) << (own & np.uint64(63)), first).view(np.int64))], ["word", "bits"])

        found = keys.select("key").mapInArrow(mark, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        made.words[found.column("word").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
        return made

    def keep(self, rows: DataFrame) -> DataFrame:
        """The rows whose ``key`` may be in the filter."""

        def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield batch.filter(pa.array(self.holds(batch.column("key"))))

        return rows.mapInArrow(some, rows.schema)


class VectorMemory:
    """The vectors of one model in a folder that driver and executors share. Rows are only ever added; two jobs that embed the same text at the same time
    both add it, and either vector serves."""

    def __init__(self, spark: SparkSession, folder: str, embedder: Embedder):
        self.spark, self.embedder = spark, embedder
        self.path = f"{folder.rstrip('/')}/{hashlib.sha256(embedder.model_id.encode()).hexdigest()[:16]}"

    def table(self) -> DataFrame:
        """(key, embedding) of all texts known."""
        try:
            return self.spark.read.schema(_VECTORS).option("recursiveFileLookup", "true").parquet(self.path)
        except AnalysisException:  # none so far
            return self.spark.createDataFrame([], _VECTORS)

    def embed(self, rows: DataFrame, batch: int = 64, column: str = "text") -> DataFrame:
        """``rows`` with the vector of their ``column`` as ``embedding``. Distinct texts are looked up: the memory is scanned behind a Bloom filter of
        their keys, so only rows that match are shuffled; those it lacks are embedded, once each, and remembered."""
        keyed = rows.withColumn("__key", text_key(F.col(column)))
        texts = settled(keyed.groupBy(F.col("__key").alias("key")).agg(F.any_value(F.coalesce(F.col(column), F.lit(""))).alias("text")), "texts")
        known = KeyFilter.of(texts).keep(self.table()).join(texts.select("key"), "key", "left_semi").groupBy("key").agg(F.any_value("embedding").alias("embedding"))
        known = settled(known, "texts-known")
        fresh = texts.join(known.select("key"), "key", "left_anti")
        embedder = self.embedder
        part = f"{self.path}/{uuid.uuid4().hex}"
        spread(settled(fresh, "texts-new")).select("key", embed_column(F.col("text"), lambda: embedder, batch).alias("embedding")).write.parquet(part)
        vectors = known.unionByName(self.spark.read.schema(_VECTORS).parquet(part))
        return keyed.join(vectors.withColumnRenamed("key", "__key"), "__key").drop("__key")


def embedded(spark: SparkSession, rows: DataFrame, embedder: Embedder, batch: int, memory: str | None) -> DataFrame:
    """``rows`` (text) with ``embedding``: through the memory in a folder, or each row by itself without one."""
    if memory:
        return VectorMemory(spark, memory, embedder).embed(rows, batch)
    make: Callable[[], Embedder] = lambda: embedder
    return rows.withColumn("embedding", embed_column(F.col("text"), make, batch))
