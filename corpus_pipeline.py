"""Pipeline over documents: classify quality, keep one of near copies, drop benchmark leaks, mix sources, shard."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from driftclust.llm.common import cut, drop_cut, packed, table
from driftclust.llm.decontam import contaminations
from driftclust.llm.importance import Resampler
from driftclust.llm.jaccard import first_of_each
from driftclust.llm.mixing import mix_number, mix_sources, mixed_order
from driftclust.llm.ring import shard_documents
from driftclust.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier draws. Nulls, ties and empty tables: see ``importance_resample``."""
    classifier = Resampler(docs, table(spark, sf_dir, "labels"))
    classifier.close()
    return classifier.keep(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class linked by 5-word shingles at a Jaccard similarity of 0.8 the document with the smallest doc_id."""
    return first_of_each(docs, k=5, num=80, den=100)


def leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any that holds a benchmark item. Rows with a null doc_id stay."""
    found = contaminations(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """All documents in the order of the mix: the files read part after part interleave the sources to their weights."""
    return mixed_order(docs, weights)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """All documents with their shard and place: a shard's rows are numbered by slot in the order of the mix. Which shard a row is in rests on
    its doc_id alone, so that the mix holds in each shard."""
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    base, back = packed(docs, "doc_id", "text", "source")
    mixed = mix_sources(base, weights).withColumnsRenamed({"slot": "__slot", "block_offset": "__offset"}).drop("n_bytes", "block")
    mixed = cut(mixed, "mixed")
    placed = cut(shard_documents(mixed, shards=16).drop("slot"), "placed")
    drop_cut(mixed)
    numbered = mix_number(placed, "shard", "__slot", "__offset", "slot")
    return numbered.select(*(back(c) for c in docs.columns if c not in made), *made)


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", leaks), ("mixing sources", mixing), ("sharding", sharding)]

#: The classifier and the edit distances aren't expressible in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str, weights: DataFrame | None = None) -> DataFrame:
    """The stages over documents, each written as Parquet to the shared folder and read again; what a stage has read goes when
    the next has written. ``weights`` are those of the mix, as in ``mix_sources``."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir, weights) if stage in (mixing, sharding) else stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs.write.parquet(f"{base}/{i}")
            if i:
                drop_cut(before)
            docs = before = spark.read.parquet(f"{base}/{i}")
    return docs
