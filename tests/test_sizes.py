"""Results that were right on small tables only."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField

from driftclust.functions import embed
from driftclust.operators import cells, dedupe, sampling


def test_central_samples_see_members_beyond_the_newest_5000(spark):
    old = F.col("id") < 100
    rows = spark.range(5200).select(F.lit("c").alias("cluster_id"), F.col("id").cast("string").alias("item_id"), F.col("id").alias("seq"), F.timestamp_seconds("id").alias("ts"), F.array(F.when(old, 1.0).otherwise(0.8), F.when(old, 0.0).when(F.col("id") % 2 == 0, 0.6).otherwise(-0.6)).cast("array<float>").alias("embedding"))
    assert [r.item_id for r in sampling.central(rows, 3).orderBy("rank").collect()] == ["99", "98", "97"]


def test_numbers_are_dense_where_ranges_come_from_a_sample(spark):
    rows = spark.range(120_000, numPartitions=3).select((F.col("id") * 7919 % 120_000).alias("pos"), F.md5(F.col("id").cast("string")).alias("data"))
    found = dedupe.numbered(rows, "pos", 100)
    assert found.where("seq <> pos + 101 OR length(data) <> 32").count() == 0 and found.count() == 120_000


def test_rows_are_held_against_centres_a_few_at_a_time(spark):
    rows = spark.range(1000, numPartitions=1).select(F.array(F.lit(1.0)).alias("embedding"))
    seen = cells._map(rows, [StructField("n", IntegerType())], lambda b: (np.arange(b.num_rows), [np.full(b.num_rows, b.num_rows)]))
    assert seen.count() == 1000 and seen.agg(F.max("n")).first()[0] <= 256


def test_pairs_by_two_keys_are_those_of_brute_force(spark):
    x = np.random.default_rng(5).normal(size=(1500, 4))
    x[700:1300] = x[0]  # one cell of several blocks
    keys = [(f"k{i % 3}", i) for i in range(len(x))]
    rows = spark.createDataFrame([(*k, v.tolist()) for k, v in zip(keys, x)], "a string, b int, embedding array<double>")
    got = cells.CellIndex(rows, "a", "b", n_cells=9).alike(rows, 0.99, "a", "b", one_way=True)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = sorted((*keys[i], *keys[j]) for i, j in zip(*np.nonzero(u @ u.T >= 0.99)) if keys[i] < keys[j])
    assert sorted(tuple(r) for r in got.select("item.a", "item.b", F.col("key.a").alias("c"), F.col("key.b").alias("d")).collect()) == want


def test_places_remember_pairs_and_words_apart_and_few():
    places = embed.SignedPlaces(8, embed._by_md5)
    places.REMEMBERED = 50
    first = places.vector("alpha beta gamma")
    places.vector(" ".join(f"w{i} v{i % 7}" for i in range(300)))
    assert (places.vector("alpha beta gamma") == first).all() and len(places._pairs) <= 52 and embed.SignedPlaces.REMEMBERED <= 1 << 17
