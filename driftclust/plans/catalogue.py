"""The engine's operators as queries over whole tables. ``plans.oracles`` says the same in SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.evaluation import metrics as M
from driftclust.functions import embed, keys, terms, text, vector
from driftclust.functions.memory import VectorMemory
from driftclust.operators import assign as A
from driftclust.operators import dedupe, lifecycle, sampling, scoring, timeline
from driftclust.operators import discover as D
from driftclust.operators.cells import CellIndex, similar_pairs
from driftclust.operators.whole import whole_groups
from driftclust.session import settled, shared_folder, spread

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# Parameters that the SQL repeats.
K, EXEMPLARS, SEED, PERCENTILE, LOW, HIGH = 5, 8, 42, 5.0, 0.15, 0.90
GAP, GRACE = timedelta(days=1), timedelta(days=2)
NOW = datetime(2024, 1, 29)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def members(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings as members of the clusters that their labels name."""
    return table(spark, d, "embeddings").select(F.col("label").cast("string").alias("cluster_id"), F.col("vec_id").cast("string").alias("item_id"), "embedding", "vec_id")


def exemplars(spark: SparkSession, d: str) -> DataFrame:
    return scoring.draw_exemplars(members(spark, d), EXEMPLARS, SEED)


def limits(spark: SparkSession, d: str) -> DataFrame:
    return scoring.thresholds(scoring.member_scores(members(spark, d), exemplars(spark, d), K), PERCENTILE, LOW, HIGH)


def clusters(spark: SparkSession, d: str) -> DataFrame:
    return limits(spark, d).select(F.col("cluster_id").alias("id"), "threshold")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def user_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Users as clusters: size and times of their events, open and unlocked."""
    stats = events(spark, d).groupBy(F.col("user_id").cast("string").alias("id")).agg(F.count("*").alias("size"), F.min(F.col("ts").cast("timestamp")).alias("first_seen"), F.max(F.col("ts").cast("timestamp")).alias("last_seen"))
    return stats.select("id", F.lit("open").alias("status"), "size", "first_seen", "last_seen", F.lit(False).alias("status_locked"), F.lit(None).cast("timestamp").alias("closed_at"), F.col("size").alias("seen_count"), F.col("first_seen").alias("opened_at"))


def now_of(spark: SparkSession, d: str) -> datetime:
    """The job's clock: the midnight after the last event."""
    last = events(spark, d).agg(F.max("ts")).first()[0]
    return (last.replace(tzinfo=None) + timedelta(days=1)).replace(hour=0, minute=0, second=0, microsecond=0)


def ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


# --- vectors, exemplars, scores ---------------------------------------------------------------------------------


@query
def q01_centroid_cosine(spark, d):
    """Cosine of every vector with the centroid of its cluster."""
    m = members(spark, d)
    return m.join(scoring.centroids(m), "cluster_id").select("vec_id", F.round(vector.dot("embedding", "centroid"), 6).alias("cosine"), F.round(vector.norm("embedding"), 6).alias("norm"))


@query
def q02_topk_mean(spark, d):
    """Score of every item against every cluster."""
    items = members(spark, d).select("item_id", "embedding")
    found = A.all_scores(items, exemplars(spark, d), members(spark, d).select(F.col("cluster_id").alias("id"), F.lit(0.0).alias("threshold")).distinct(), K)
    return found.select(F.col("item_id").cast("long").alias("vec_id"), "cluster_id", (F.round("score", 6) + F.lit(0.0)).alias("score"))  # no negative zero


@query
def q03_exemplars(spark, d):
    """Exemplars drawn for every cluster."""
    return exemplars(spark, d).select("cluster_id", F.col("pos").cast("long").alias("pos"), "item_id")


@query
def q04_member_scores(spark, d):
    """Leave-one-out scores of every member."""
    return scoring.member_scores(members(spark, d), exemplars(spark, d), K).select("cluster_id", "item_id", F.round("score", 6).alias("score"))


@query
def q05_cluster_threshold(spark, d):
    """Thresholds of all clusters."""
    return limits(spark, d).select("cluster_id", F.round("cohesion", 6).alias("cohesion"), F.round("threshold", 6).alias("threshold"))


@query
def q06_cohesion_gate(spark, d):
    """Which groups would open as clusters."""
    return limits(spark, d).select("cluster_id", F.when(F.col("cohesion") < LOW, "rejected").otherwise("opened").alias("verdict"))


@query
def q07_assign_batch(spark, d):
    """Decisions for all vectors against the clusters of their labels."""
    return A.assign(members(spark, d), exemplars(spark, d), clusters(spark, d), K)


@query
def q08_assign_nearest(spark, d):
    """Decisions from the 20 nearest exemplars of each vector."""
    return A.assign_nearest(members(spark, d), exemplars(spark, d), clusters(spark, d), 20, K)


def _pairs(spark, d):
    ids = members(spark, d).select("cluster_id").distinct()
    return ids.select(F.col("cluster_id").alias("a")).crossJoin(ids.select(F.col("cluster_id").alias("b"))).where("a < b")


@query
def q09_set_similarity(spark, d):
    """Symmetric similarity of all pairs of clusters."""
    x = exemplars(spark, d)
    return scoring.symmetric_similarity(x, x, _pairs(spark, d), K).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query
def q10_merge_candidates(spark, d):
    """Pairs of clusters to merge at a low threshold; pairs of neighbouring names are barred."""
    ids = members(spark, d).select(F.col("cluster_id").alias("id")).distinct()
    barred = _pairs(spark, d).where(F.col("b").cast("int") - F.col("a").cast("int") == 1)
    return lifecycle.merge_candidates(ids, exemplars(spark, d), barred, 0.08, K).select("a", "b", F.round("similarity", 6).alias("similarity"))


def _sized(spark, d):
    return members(spark, d).groupBy(F.col("cluster_id").alias("id")).agg(F.count("*").alias("size"), F.min("vec_id").alias("opened_at"))


@query
def q11_survivors(spark, d):
    """The survivor of every pair of clusters."""
    return lifecycle.survivors(_pairs(spark, d), _sized(spark, d))


@query
def q12_centroids(spark, d):
    """Centroids of all clusters by coordinate."""
    return scoring.centroids(members(spark, d)).select("cluster_id", F.posexplode("centroid").alias("dim", "x")).select("cluster_id", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


def _timed(spark, d):
    """Members with a time: the later the smaller the id."""
    return members(spark, d).withColumn("seq", F.col("vec_id")).withColumn("ts", F.timestamp_micros(F.lit(1_700_000_000_000_000) - F.col("vec_id") * 1_000_000))


@query
def q13_central_sample(spark, d):
    """The 5 most central members of every cluster."""
    return sampling.central(_timed(spark, d), 5).select("cluster_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query
def q14_recent_sample(spark, d):
    """The 5 newest events of every user."""
    rows = events(spark, d).select(F.col("user_id").alias("cluster_id"), "event_id", "ts", F.col("event_id").alias("seq"))
    return sampling.recent(rows, 5).select("cluster_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query
def q15_random_sample(spark, d):
    """5 random members of every cluster."""
    return sampling.random(members(spark, d), 5, SEED).select("cluster_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query
def q16_mixed_sample(spark, d):
    """9 members of every cluster, central, recent and random ones."""
    return sampling.mixed(_timed(spark, d), 9, SEED).select("cluster_id", "item_id", F.col("rank").cast("long").alias("rank"))


@query
def q17_counts_hourly(spark, d):
    """Events of every type by hour, without gaps."""
    return sampling.counts_over_time(events(spark, d).select("event_type", "ts"), "event_type", sampling.HOUR).select("event_type", ntz("bucket_start"), "n")


@query
def q18_counts_auto(spark, d):
    """Events of every user by day, or by hour where they span under two days."""
    return sampling.counts_over_time(events(spark, d).select("user_id", "ts"), "user_id").select("user_id", ntz("bucket_start"), "n")


# --- identity, text, terms ---------------------------------------------------------------------------------------


@query
def q19_dedupe_first(spark, d):
    """The first document of every text."""
    return dedupe.first_of_each(table(spark, d, "documents").select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "doc_id"), "text_md5", "doc_id")


@query
def q20_unknown_items(spark, d):
    """Documents that have no label yet."""
    return dedupe.unknown(table(spark, d, "documents").select("doc_id", "source"), table(spark, d, "labels"), "doc_id")


@query
def q21_number_items(spark, d):
    """Dense numbers for the documents without labels, after those with labels."""
    labelled = table(spark, d, "labels").select("doc_id").distinct().count()
    return dedupe.numbered(dedupe.unknown(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id"), "doc_id", labelled)


@query
def q22_normalize(spark, d):
    """Documents with white space collapsed, cut to 400 characters, by digest and length."""
    from driftclust.config import Preprocess

    whole = table(spark, d, "documents").select("doc_id", "text")
    clean = text.preprocess(whole, Preprocess(normalize=True))
    short = text.preprocess(clean, Preprocess(max_chars=400)).withColumnRenamed("text", "short")
    return clean.join(short, "doc_id").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"), F.length("text").cast("long").alias("n_chars"), F.md5(F.col("short").cast("binary")).alias("short_md5"))


@query
def q23_redact(spark, d):
    """Personal data of every document as tokens: how many of each, and a digest of the text without white space (word borders beside
    letters with accents, at which a number may take the space after it, are Unicode's here and ASCII's in the SQL)."""
    red = text.redact(F.col("text"))
    count = lambda t: ((F.length("r") - F.length(F.replace(F.col("r"), F.lit(t), F.lit("")))) / len(t)).cast("long")
    return table(spark, d, "documents").select("doc_id", red.alias("r")).select("doc_id", *(count(f"[{t}]").alias(t.lower()) for t in ("EMAIL", "CARD", "SSN", "IP", "PHONE", "URL")), F.md5(F.regexp_replace("r", r"\s+", "").cast("binary")).alias("text_md5"))


@query
def q24_features(spark, d):
    """Words, word pairs and trigrams of all documents, counted over the corpus."""
    return text.feature_counts(table(spark, d, "documents"))


@query
def q25_embed_md5(spark, d):
    """Signed feature hashing of all documents by md5, as sparse rows."""
    return embed.hashed_features(table(spark, d, "documents").select("doc_id", "text"), "doc_id", 256)


@query
def q26_embed_hashing(spark, d):
    """Signed feature hashing by BLAKE2b of all documents: norm and coordinates that aren't zero."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", embed.embed_column(F.col("text"), lambda: embed.HashingEmbedder(256)).alias("v"))
    return docs.select("doc_id", F.round(vector.norm("v"), 4).alias("norm"), F.size(F.filter("v", lambda x: x != 0)).cast("long").alias("nonzero"))


def _terms(spark, d, longest):
    return terms.term_scores(terms.term_counts(table(spark, d, "documents"), "source", longest), "source")


@query
def q27_ctfidf_terms(spark, d):
    """The 5 most telling words of every source."""
    order = W.partitionBy("source").orderBy(F.desc("score"), "term")
    scored = _terms(spark, d, 1).withColumn("score", F.round("score", 9))
    return scored.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("source", "term", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query
def q28_ctfidf_labels(spark, d):
    """A label for every source: words and pairs, none containing another."""
    docs = table(spark, d, "documents").select("source", F.col("doc_id").alias("pos"), "text")
    return terms.labels(docs, "source", 5)


@query
def q29_cluster_id(spark, d):
    """Names of all clusters by their members."""
    return members(spark, d).groupBy(F.col("cluster_id").alias("label")).agg(keys.cluster_id(F.collect_list("item_id")).alias("id"))


# --- lifecycle -----------------------------------------------------------------------------------------------------


@query
def q30_attach(spark, d):
    """Users' clusters with all purchases attached to what their other events made."""
    e = events(spark, d).withColumn("ts", F.col("ts").cast("timestamp"))
    base = e.where("event_type <> 'purchase'").groupBy(F.col("user_id").cast("string").alias("id")).agg(F.count("*").alias("size"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    base = base.select("id", F.lit("closed").alias("status"), "size", "first_seen", "last_seen", F.col("last_seen").alias("closed_at"), F.col("size").alias("seen_count"))
    arrivals = e.where("event_type = 'purchase'").select(F.col("user_id").cast("string").alias("cluster_id"), "ts")
    out = lifecycle.attach(base, arrivals)
    return out.select("id", "status", F.col("size").cast("long").alias("size"), F.col("seen_count").cast("long").alias("seen_count"), ntz("first_seen"), ntz("last_seen"), ntz("closed_at"))


@query
def q31_close_quiet(spark, d):
    """Users quiet for a day, or with fewer than 3 events in it."""
    c, now = user_clusters(spark, d), now_of(spark, d)
    times = events(spark, d).select(F.col("user_id").cast("string").alias("cluster_id"), F.col("ts").cast("timestamp").alias("ts"))
    few = lifecycle.quiet(c, times, now, GAP, 3).select("id", F.lit(3).cast("long").alias("floor"))
    return few.unionAll(lifecycle.quiet(c, times, now, GAP, 1).select("id", F.lit(1).cast("long").alias("floor")))


def _closed(spark, d):
    """Users closed a day after their last event."""
    return user_clusters(spark, d).withColumn("status", F.lit("closed")).withColumn("closed_at", F.col("last_seen") + F.expr("interval 1 day"))


@query
def q32_archive_expired(spark, d):
    """Closed users whose grace of two days is over at the clock's time and two days later."""
    c, now = _closed(spark, d), now_of(spark, d)
    late = now + timedelta(days=2)
    return lifecycle.expired(c, now, GRACE).select("id", F.lit("now").alias("at")).unionAll(lifecycle.expired(c, late, GRACE).select("id", F.lit("later").alias("at")))


@query
def q33_matchable(spark, d):
    """Users that new items could still join."""
    c = _closed(spark, d).withColumn("status_locked", F.col("size") % 5 == 0).withColumn("status", F.when(F.col("size") % 2 == 0, "open").otherwise(F.col("status")))
    return lifecycle.matchable(c, now_of(spark, d), GRACE).select("id", "status")


@query
def q34_orphan_stale(spark, d):
    """Events that waited for more than three weeks."""
    rows = events(spark, d).select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.when(F.col("event_type") == "purchase", "assigned").otherwise("buffered").alias("status"))
    return lifecycle.stale(rows, now_of(spark, d), timedelta(days=21)).select("event_id")


@query
def q35_relabel_due(spark, d):
    """Users with 1.25 times as many events as those that aren't views, or more."""
    c = events(spark, d).groupBy(F.col("user_id").cast("string").alias("id")).agg(F.count("*").alias("size"), F.count_if(F.col("event_type") != "view").alias("label_size")).withColumn("status", F.lit("open"))
    return lifecycle.grown(c, 1.25).select("id", "size", "label_size")


@query
def q36_sessions(spark, d):
    """Sessions of every user with pauses of a day at most."""
    s = timeline.sessions(events(spark, d).select("user_id", "ts"), "user_id", GAP)
    return s.select("user_id", "start", "end", "n")


def _log(spark, d):
    """An event log: the first event of a session opens or reopens a user, its end closes it."""
    s = timeline.sessions(events(spark, d).select(F.col("user_id").cast("string").alias("cluster_id"), "ts"), "cluster_id", GAP)
    nth = F.row_number().over(W.partitionBy("cluster_id").orderBy("start"))
    s = s.withColumn("nth", nth)
    starts = s.select("cluster_id", F.when(F.col("nth") == 1, "cluster.opened").otherwise("cluster.reopened").alias("type"), F.col("start").alias("ts"), (F.col("nth") * 2).alias("seq"))
    ends = s.where(F.col("n") > 1).select("cluster_id", F.lit("cluster.closed").alias("type"), F.col("end").alias("ts"), (F.col("nth") * 2 + 1).alias("seq"))
    return starts.unionAll(ends)


@query
def q37_open_segments(spark, d):
    """When users were open, from an event log."""
    return timeline.open_segments(_log(spark, d)).select("cluster_id", "start", "end", "open_at_end")


@query
def q38_resolve_chain(spark, d):
    """Where merge pointers lead: every customer points to the one half its number."""
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_custkey") > 1, F.floor(F.col("c_custkey") / 2)).alias("merged_into"))
    return lifecycle.resolve(c).select("id", "final", "hops")


@query
def q49_event_log(spark, d):
    """Numbered events of a batch of assignments, data as JSON."""
    hits = q07_assign_batch(spark, d).where("cluster_id is not null")
    rows = hits.select(F.col("item_id").cast("long").alias("pos"), F.lit("item.assigned").alias("type"), "cluster_id", "item_id", F.to_json(F.struct((F.col("score") * 1000).cast("long").alias("score"))).alias("data"))
    return dedupe.numbered(rows, "pos", 100).select("seq", "type", "cluster_id", "item_id", "data")


@query
def q50_make_batches(spark, d):
    """Replay batches of the events of every user: cut before they span 36 hours or hold more than 5 events."""
    rows = timeline.batch_numbers(events(spark, d).select("event_id", "user_id", "ts"), timedelta(hours=36), 5, "user_id")
    return rows.groupBy("user_id", "batch").agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))


@query
def q51_discover_groups(spark, d):
    """Density groups of all vectors, fitted together whatever their number: sizes, noise included."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("vec_id").alias("seq"), "embedding")
    return whole_groups(rows, 5, 3, 5).groupBy("label").agg(F.count("*").alias("n"))


@query
def q52_merge_greedy(spark, d):
    """Pairs of clusters merged in one sweep, most similar first, each cluster once."""
    return lifecycle.greedy_pairs(q09_set_similarity(spark, d).where("similarity >= 0.1"))


def _seekers(spark, d):
    return table(spark, d, "embeddings").where("vec_id % 50 = 0").select("vec_id", "embedding")


@query
def q59_nearest_exact(spark, d):
    """The 10 vectors nearest to every vector whose id is divisible by 50, itself included, from cells, exactly."""
    found = CellIndex(table(spark, d, "embeddings"), "vec_id").nearest(_seekers(spark, d), 10, "vec_id", probes=None)
    return found.select(F.col("item.vec_id").alias("vec_id"), F.col("rank").cast("long").alias("rank"), F.col("key.vec_id").alias("nearest"), F.round("sim", 6).alias("sim"))


@query
def q60_nearest_recall(spark, d):
    """How many of the 10 nearest of those vectors the approximate index finds, with as many probes as a sample of all vectors needs for 95 %."""
    index = CellIndex(table(spark, d, "embeddings"), "vec_id")
    probes = index.probes_for(table(spark, d, "embeddings"), 10, 0.95, "vec_id")
    exact, near = (index.nearest(_seekers(spark, d), 10, "vec_id", probes=p).select("item", "key") for p in (None, probes))
    hits = exact.join(near.withColumn("hit", F.lit(1)), ["item", "key"], "left")
    return hits.groupBy(F.col("item.vec_id").alias("vec_id")).agg(F.count("*").alias("n"), F.count("hit").alias("hits"))


@query
def q61_similar_vectors(spark, d):
    """All pairs of vectors with a cosine of 0.3 or more, by a join over cells."""
    pairs = similar_pairs(table(spark, d, "embeddings"), 0.3, "vec_id")
    return pairs.select("a", "b", F.round("cosine", 6).alias("cosine"))


@query
def q62_vector_memory(spark, d):
    """All documents embedded through a memory of vectors, twice: texts, distinct ones, those remembered, those that came out with a vector."""
    memory = VectorMemory(spark, f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}", embed.HashingEmbedder(64))
    docs = table(spark, d, "documents").select("doc_id", "text")
    memory.embed(docs).count()
    again = memory.embed(docs).agg(F.count("*").alias("n"), F.count_distinct(F.coalesce("text", F.lit(""))).alias("n_distinct"), F.count("embedding").alias("n_vectors"))
    return again.crossJoin(memory.table().agg(F.count("*").alias("remembered")))  # single rows


# --- evaluation ------------------------------------------------------------------------------------------------------


def _judged(spark, d):
    """Documents as items: sources as clusters, languages as truth, Spanish as noise."""
    return table(spark, d, "documents").select(F.col("source").alias("cluster_id"), F.when(F.col("lang") == "es", M.NOISE).otherwise(F.col("lang")).alias("label"), F.when(F.col("n_chars") % 7 == 0, "buffered").otherwise("assigned").alias("status"))


def _assigned(spark, d):
    return _judged(spark, d).where("status = 'assigned'")


@query
def q39_majority(spark, d):
    """The majority topic of every cluster."""
    return M.majorities(_assigned(spark, d)).select("cluster_id", "majority", F.col("n").cast("long").alias("n"), F.col("total").cast("long").alias("total"))


@query
def q40_mixed_clusters(spark, d):
    """Clusters that mix topics."""
    return M.mixed_clusters(_assigned(spark, d), 0.12).select("cluster_id", F.round("second_share", 6).alias("second_share"), "mixed")


@query
def q41_quality(spark, d):
    """Precision, fragmentation, false merges and orphan rates."""
    items, m = _judged(spark, d), M.majorities(_assigned(spark, d))
    one = m.agg(F.round(F.sum("n") / F.sum("total"), 4).alias("precision"), F.count("*").alias("clusters"))
    frag = m.where(F.col("majority") != M.NOISE).agg(F.round(F.count("*") / F.countDistinct("majority"), 3).alias("fragmentation"))
    false = M.mixed_clusters(_assigned(spark, d), 0.12).agg(F.round(F.avg(F.col("mixed").cast("double")), 4).alias("false_merge_rate"))
    lost = items.agg(F.round(F.avg(F.when(F.col("status") != "assigned", 1.0).otherwise(0.0)), 4).alias("orphan_rate"))
    topical = items.where(F.col("label") != M.NOISE).agg(F.round(F.avg(F.when(F.col("status") != "assigned", 1.0).otherwise(0.0)), 4).alias("topic_orphan_rate"))
    return one.crossJoin(frag).crossJoin(false).crossJoin(lost).crossJoin(topical)  # single rows


@query
def q44_time_to_detect(spark, d):
    """Median hours from the first event of a user to the first purchase."""
    per = events(spark, d).groupBy("user_id").agg(F.min("ts").alias("first"), F.min(F.when(F.col("event_type") == "purchase", F.col("ts"))).alias("found")).where("found is not null")
    return per.agg(F.round(F.median(M.hours(F.col("found"), F.col("first"))), 2).alias("median_hours"), F.count("*").alias("users"))


@query
def q45_close_lag(spark, d):
    """Median hours from the last event of a user to its final close."""
    closes = timeline.final_closes(_log(spark, d).withColumn("ts", F.col("ts") + F.expr("interval 1 day")))
    last = events(spark, d).groupBy(F.col("user_id").cast("string").alias("cluster_id")).agg(F.max("ts").alias("last"))
    return closes.join(last, "cluster_id").agg(F.round(F.median(M.hours(F.col("closed_at"), F.col("last"))), 2).alias("median_hours"), F.count("*").alias("users"))


@query
def q46_status_counts(spark, d):
    """Events of each known type, those without any too."""
    return M.status_counts(events(spark, d), ("click", "view", "purchase", "signup", "logout", "refund"), "event_type")


@query
def q47_pareto_front(spark, d):
    """Parts that no other part beats in price and size."""
    parts = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"), F.col("p_retailprice").cast("double").alias("p_retailprice"))
    return M.pareto_front(parts, "p_partkey", "p_size", "p_retailprice")


@query
def q48_percentiles(spark, d):
    """p50 and p95 of event values by type."""
    return events(spark, d).groupBy("event_type").agg(F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


# --- streams -----------------------------------------------------------------------------------------------------------


@query
def q53_stream_counts(spark, d):
    """Events of each type and day through Structured Streaming."""
    from driftclust.streaming.windows import run_available, windowed_counts

    return run_available(spark, windowed_counts(_stream(spark, d), "event_type", "1 day"), "complete").select("event_type", ntz("start"), "n")


def _stream(spark, d):
    schema = table(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{d}/events.parquet*")


@query
def q54_stream_dedup(spark, d):
    """The users of each type, once, through Structured Streaming."""
    from driftclust.streaming.windows import deduplicated, run_available

    return run_available(spark, deduplicated(_stream(spark, d), ["user_id", "event_type"]), "append").select("user_id", "event_type")


@query
def q55_stream_sessions(spark, d):
    """Sessions of every user through Structured Streaming."""
    from driftclust.streaming.windows import run_available, streamed_sessions

    return run_available(spark, streamed_sessions(_stream(spark, d), "user_id", GAP), "complete").select("user_id", ntz("start"), ntz("end"), "n")


@query
def q63_stream_closings(spark, d):
    """When users were closed, a day after an event without another, by timers of Structured Streaming; each type of event is a stream of its own."""
    from driftclust.streaming.lifecycle import cluster_changes
    from driftclust.streaming.windows import run_available

    changes = cluster_changes(_stream(spark, d).select(F.col("event_type").alias("stream_key"), F.col("user_id").alias("cluster_id"), "ts"), GAP)
    return run_available(spark, changes, "append").where("type = 'cluster.closed'").select("stream_key", "cluster_id", ntz("at"), "size")


@query
def q64_stream_orphans(spark, d):
    """Events other than purchases that waited for over three weeks, by timers of Structured Streaming."""
    from driftclust.streaming.lifecycle import orphans
    from driftclust.streaming.windows import run_available

    states = _stream(spark, d).select(F.col("event_type").alias("stream_key"), F.col("event_id").alias("item_id"), "ts", F.when(F.col("event_type") == "purchase", "assigned").otherwise("buffered").alias("status"))
    return run_available(spark, orphans(states, timedelta(days=21)), "append").select("stream_key", "item_id", ntz("at"))


# --- details, migration --------------------------------------------------------------------------------------------------


@query
def q57_cluster_detail(spark, d):
    """Every user's newest event, first and last day and events, in one row."""
    newest = q14_recent_sample(spark, d).where("rank = 1").select(F.col("cluster_id").alias("user_id"), F.col("event_id").alias("newest"))
    days = q18_counts_auto(spark, d).groupBy("user_id").agg(F.count("*").alias("buckets"), F.sum("n").alias("n"), F.max("n").alias("most"))
    return newest.join(days, "user_id")


@query
def q58_reembed(spark, d):
    """All documents under two models: how many coordinates each uses."""
    return embed.used_coordinates(table(spark, d, "documents").select("doc_id", "text"), (256, 128))

