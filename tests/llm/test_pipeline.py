"""The pipeline's stages against brute force and planted cases over a small table."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from driftclust.llm import decontam, mixing, ring

WORDS = [a + b for a in "ka lo mi ru te sa ne vo".split() for b in "ron lim dat pel sor vin gum tas bek".split()]


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(1)
    d = str(tmp_path_factory.mktemp("sf"))
    prose = lambda n: " ".join(r.choice(WORDS) for _ in range(n))
    items = [(i, prose(40)) for i in range(5)]
    docs, kind = [], {}
    for i in range(300):
        docs.append([i, prose(r.randint(60, 200)), "en", r.choice(["a", "a", "b", None]), 1])
        kind[i] = "clean"
    for i in range(300, 340):
        docs.append([i, " ".join(w + "###" for w in prose(80).split()), "en", "b", 1])
        kind[i] = "junk"
    for i in range(340, 370):
        words = docs[i - 340][1].split()
        words[len(words) // 2] = "changed"
        docs.append([i, " ".join(words), "en", "a", 1])
        kind[i] = "copy"
    for i in range(370, 385):
        docs.append([i, f"{prose(40)} {items[i % 5][1]} {prose(40)}", "de", "c", 1])
        kind[i] = "leak"
    labels = [(i, int(kind[i] == "clean"), 0) for i in range(0, 340, 2)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, kind, items


def test_planted_cases(spark, corpus):
    d, kind, _ = corpus
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, d).collect()}
    kept = {k: sum(kind[i] == k for i in got) for k in ("clean", "junk", "copy", "leak")}
    assert kept["junk"] == kept["copy"] == kept["leak"] == 0
    assert kept["clean"] >= 295
    counts = [sum(r.shard == s for r in got.values()) for s in range(16)]
    assert max(counts) - min(counts) <= 1


def test_stages_keep_columns_and_whole_inputs(spark, corpus, tmp_path):
    d, kind, items = corpus
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [k for k, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources", "sharding"]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if i < 4:
            assert out.columns == docs.columns
    mixed = corpus_pipeline.mixing(spark, docs, d)
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(kind)
    clean = corpus_pipeline.leaks(spark, docs, d)
    held = {r.doc_id for r in docs.collect() if any(decontam.normal(t) in decontam.normal(r.text) for _, t in items)}
    assert {r.doc_id for r in clean.collect()} == set(kind) - held


def test_stages_of_no_rows(spark, corpus):
    d, _, _ = corpus
    none = spark.read.parquet(f"{d}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, d).count() == 0


def test_stages_with_nulls_and_extra_columns(spark, corpus):
    d, _, _ = corpus
    rows = [(None, None, None, None, None, 1), (1, None, None, None, None, 2), (1, "x", "en", None, None, 3), (2, "", None, "a", 5, 4), (2, "", None, "a", 5, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, slot int")
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d).collect()
        assert len(out) == len(rows) or i == 1


def test_mix_reaches_the_result(spark, corpus):
    d, _, _ = corpus
    weights = lambda a, b: spark.createDataFrame([("a", a), ("b", b), (None, 1)], "source string, weight int")
    found = {w: {r.doc_id: r for r in corpus_pipeline.run(spark, d, weights(*w)).collect()} for w in [(9, 1), (1, 9)]}
    one, other = found.values()
    assert {i: r.shard for i, r in one.items()} == {i: r.shard for i, r in other.items()}
    assert {i: r.slot for i, r in one.items()} != {i: r.slot for i, r in other.items()}


def test_shards_are_numbered_in_mix_order(spark, corpus):
    d, _, _ = corpus
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(WORDS) for _ in range(4000)), "en", r.choice(["a", "a", "b", None, "z"]), 1) for i in range(160)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    weights = spark.createDataFrame([("a", 3), ("b", 1), (None, 2)], "source string, weight int")
    got = corpus_pipeline.sharding(spark, docs, d, weights).collect()
    plain = {x.doc_id: x.shard for x in ring.shard_documents(docs, shards=16).collect()}
    at = {x.doc_id: (x.slot is None, x.slot, x.block_offset, x.doc_id) for x in mixing.mix_sources(docs, weights).collect()}
    assert {x.doc_id: x.shard for x in got} == plain and len({x[1] for x in at.values()}) > 5
    for shard in range(16):
        mine = sorted((x for x in got if x.shard == shard), key=lambda x: x.slot)
        assert [x.slot for x in mine] == list(range(len(mine)))
        assert [x.doc_id for x in mine] == sorted((x.doc_id for x in mine), key=lambda i: [v if v is not None else 0 for v in at[i]])
