"""The engine: ingest, discover, sweep and the operator's overrides, each one commit of the state."""

from __future__ import annotations

import logging
import threading
import uuid
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import wraps
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftclust import schema as S
from driftclust.clock import Clock, SystemClock, as_utc
from driftclust.config import Config
from driftclust.events import Event, EventRoutes
from driftclust.evaluation.metrics import status_counts
from driftclust.functions.embed import Embedder, make_embedder
from driftclust.functions.keys import cluster_id_of
from driftclust.functions.memory import embedded
from driftclust.functions.terms import labels as ctfidf_labels
from driftclust.functions.text import preprocess
from driftclust.functions.titles import title_labeler
from driftclust.operators import discover as D
from driftclust.operators import lifecycle as L
from driftclust.operators import sampling
from driftclust.operators.assign import Index, assign, assign_nearest, make_index
from driftclust.operators.dedupe import first_of_each, numbered, unknown
from driftclust.operators.layout import layout
from driftclust.operators.scoring import draw_exemplars, member_scores, thresholds
from driftclust.session import spread
from driftclust.sinks.delivery import Delivery, hook_of
from driftclust.state.store import Conflict, Snapshot, StateStore, Transaction

log = logging.getLogger("driftclust")

DISCOVERY_LOCK_TTL = timedelta(hours=1)
#: A label is made from LABEL_TEXTS of a cluster's LABEL_NEWEST newest texts, drawn at random but the same for a seed.
LABEL_NEWEST, LABEL_TEXTS = 500, 100


@dataclass(frozen=True)
class Item:
    id: str
    text: str
    timestamp: datetime
    metadata: dict[str, Any] = field(default_factory=dict)


class DiscoveryReport(NamedTuple):
    snapshot_size: int
    opened: tuple[str, ...] = ()
    folded: tuple[str, ...] = ()
    noise: int = 0
    reassigned: int = 0
    skipped_reason: str | None = None
    rejected: int = 0


class SweepReport(NamedTuple):
    closed: tuple[str, ...] = ()
    archived: tuple[str, ...] = ()
    merged: tuple[tuple[str, str], ...] = ()
    orphaned: int = 0
    relabeled: tuple[str, ...] = ()


class ClusterDetail(NamedTuple):
    cluster: dict[str, Any]
    counts_over_time: DataFrame
    sample: DataFrame


class ModelMismatch(RuntimeError):
    """The state holds vectors of another model."""


def _json(**fields: Column | Any) -> Column:
    """A JSON object with sorted keys; nulls left out."""
    return F.to_json(F.struct(*((v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in sorted(fields.items()))))


def _event(kind: str, rows: DataFrame, *order: Column, cluster: Column | None = None, item: Column | None = None, ts: datetime, **data: Any) -> DataFrame:
    null = F.lit(None).cast("string")
    return rows.select(
        F.lit(kind).alias("type"), F.lit(ts).alias("ts"), (cluster if cluster is not None else null).alias("cluster_id"), (item if item is not None else null).alias("item_id"), (_json(**data) if data else F.lit("{}")).alias("data"), *(c.alias(f"o{i}") for i, c in enumerate(order))
    )


def _job(method: Callable) -> Callable:
    """A method that runs as a job, with a scratch folder."""

    @wraps(method)
    def run(self, *args, **kwargs):
        with self.scratch():
            return method(self, *args, **kwargs)

    return run


class ClusteringEngine:
    """Clusters a stream of texts. All times come from the clock, all state from the store; each job reads one version and makes the next."""

    def __init__(self, spark: SparkSession, config: Config | None = None, *, store: StateStore | None = None, embedder: Embedder | None = None, labeler: Callable[[DataFrame, DataFrame], DataFrame] | None = None, clock: Clock | None = None, bus: EventRoutes | None = None, hook: Callable[[Column], Column] | None = None, complete: Callable[[str], str] | None = None):
        self.spark, self.config = spark, config or Config()
        self.store = store or StateStore.open(spark, self.config.store)
        self.embedder = embedder or make_embedder(self.config.embedder, self.config.model_dir)
        self.clock, self.bus, self.hook = clock or SystemClock(), EventRoutes() if bus is None else bus, hook
        if self.config.labeler == "title" and labeler is None and complete is None:
            raise ValueError("titles need complete, a function from a prompt to an answer")
        self.labeler = labeler or (title_labeler(complete, terms=self.config.label_terms) if self.config.labeler == "title" else self._ctfidf)
        self._discovering, self._job = threading.Lock(), threading.local()
        self._index: Index | None = None
        self.deliveries = [Delivery(spark, hook_of(h), f"{self.store.path}/_deliveries") for h in self.config.webhooks]
        self._delivering, self._posts = threading.Lock(), deque(maxlen=100)
        self._posting = ThreadPoolExecutor(1, "deliveries") if self.deliveries else None
        self._check_model(self.store.snapshot())

    # --- shared ------------------------------------------------------------------------------------------------

    def _check_model(self, snapshot: Snapshot) -> None:
        stored = snapshot.meta("model_id")
        if stored and stored != self.embedder.model_id:
            raise ModelMismatch(f"the state holds vectors of {stored}, not of {self.embedder.model_id}; re-embed it first")

    @contextmanager
    def scratch(self) -> Iterator[None]:
        """A folder of this job's own for intermediate results, deleted by it alone when it ends; jobs inside a job share it."""
        if getattr(self._job, "folder", None):
            yield
            return
        self._job.folder = f"_stage/{uuid.uuid4().hex}"
        try:
            yield
        finally:
            self.store.files.delete(self._job.folder)
            self._job.folder = None

    def stage(self, df: DataFrame, what: str) -> DataFrame:
        """Write an intermediate result next to the state and read it again: it is computed once and outlives executors."""
        path = f"{self.store.path}/{self._job.folder}/{what}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def _commit(self, txn: Transaction) -> None:
        before = self.store.manifest(txn.number - 1)["max_event_seq"]
        txn.compact()
        txn.commit()
        if self.bus:
            told, types = self.store.snapshot().events(before), self.bus.types()
            self.bus.deliver(map(Event.of, (told if types is None else told.where(F.col("type").isin(*types))).toLocalIterator()))
        if self.deliveries:
            self._posts.append(self._posting.submit(self.deliver))

    def deliver(self) -> list[dict[str, int]]:
        """Post all committed events that their webhooks haven't had, by Spark tasks: counts of the outcomes of each hook. Runs by itself, beside the
        jobs, after each commit; one that fails is made up for by the next."""
        with self._delivering:
            events = self.store.snapshot().events()
            return [d.run(events) for d in self.deliveries]

    def _retry(self, job: Callable[[], Any], times: int = 3) -> Any:
        for attempt in range(times):
            try:
                return job()
            except Conflict:
                if attempt + 1 == times:
                    raise
                log.info("another writer committed first; the job runs again")

    def _assign(self, items: DataFrame, txn: Transaction, now: datetime) -> DataFrame:
        """Decisions against the clusters that can take items now. Their index stays on the driver, if it is small enough, for as long as the
        tables are the same and no closed cluster's grace ends."""
        cfg, exemplars = self.config, txn.table("exemplars")
        live = L.matchable(txn.table("clusters"), now, cfg.grace)
        if cfg.exemplar_index != "exact":
            return assign_nearest(items, exemplars, live, cfg.exemplar_neighbors, cfg.match_top_k, cfg.exemplar_recall if cfg.exemplar_index == "cells" else None)
        tables = txn.manifest["tables"]
        key = (tuple(tables.get("clusters", ())), tuple(tables.get("exemplars", ())))
        if self._index is None or not self._index.serves(key, now):
            first = live.where(F.col("status") == S.CLOSED).agg(F.min("closed_at")).first()[0]
            self._index = make_index(exemplars, live, key, as_utc(first) + cfg.grace if first else None)
        return assign(items, exemplars, live, cfg.match_top_k, self._index)

    def match(self, items: DataFrame | Iterable[Item]) -> DataFrame:
        """Where items would go: the decisions of ``ingest`` (item_id, cluster_id, score, runner-up), with nothing stored."""
        txn, now = self.store.transaction(), self.clock.now()
        self._check_model(txn)
        rows = preprocess(self._input(items), self.config.preprocess, self.hook)
        return self._assign(self._embedded(rows.select(F.col("id").alias("item_id"), "text"), self.embedder).select("item_id", "embedding"), txn, now)

    def _embedded(self, rows: DataFrame, embedder: Embedder) -> DataFrame:
        return embedded(self.spark, rows, embedder, self.config.embed_batch_size, self.config.vector_memory)

    # --- ingest ------------------------------------------------------------------------------------------------

    def _input(self, items: DataFrame | Iterable[Item]) -> DataFrame:
        """(id, text, ts, metadata, pos), validated: ids and texts that aren't blank, times as UTC."""
        if isinstance(items, DataFrame):
            meta = F.col("metadata") if "metadata" in items.columns else F.lit(None).cast("map<string,string>")
            rows = items.select(F.col("id").cast("string"), F.col("text").cast("string"), F.col("ts").cast("timestamp"), meta.alias("metadata"), *([F.col("pos").cast("long")] if "pos" in items.columns else []))
            if "pos" not in items.columns:
                rows = rows.withColumn("pos", F.monotonically_increasing_id())
            bad = rows.where("id is null or trim(id) = '' or text is null or trim(text) = '' or ts is null").limit(1).collect()
            if bad:
                raise ValueError(f"items need an id, a text and a time: {bad[0].asDict()}")
            return rows
        made = []
        for i, item in enumerate(items):
            if not isinstance(item, Item):
                raise TypeError(f"not an Item: {item!r}")
            if not isinstance(item.id, str) or not item.id.strip() or not isinstance(item.text, str) or not item.text.strip():
                raise ValueError(f"items need an id and a text: {item!r}")
            if not isinstance(item.timestamp, datetime):
                raise TypeError(f"not a time: {item.timestamp!r}")
            made.append((item.id, item.text, as_utc(item.timestamp), {k: str(v) for k, v in item.metadata.items()}, i))
        return self.spark.createDataFrame(made, "id string, text string, ts timestamp, metadata map<string,string>, pos long")

    @_job
    def ingest(self, items: DataFrame | Iterable[Item], batch: str | None = None) -> DataFrame:
        """Place a batch of items (id, text, ts, metadata): each new one joins the cluster it fits, or waits in the buffer.

        Returns (pos, item_id, cluster_id, score, runner_up_cluster_id, runner_up_score, duplicate) for every input row. Known ids and repeats
        within the batch are duplicates and change nothing. Items of a batch don't see each other. A ``batch`` name that was
        committed before is skipped.
        """
        rows = self._input(items)
        return self._retry(lambda: self._ingest(rows, batch))

    def _ingest(self, rows: DataFrame, batch: str | None) -> DataFrame:
        cfg, now, txn = self.config, self.clock.now(), self.store.transaction()
        self._check_model(txn)
        rows = self.stage(rows, "input")
        if batch is None or batch not in txn.manifest["batches"]:
            first = rows.join(first_of_each(rows, "id", "pos"), ["id", "pos"])
            fresh = unknown(first, txn.table("items"), "id")
            fresh = spread(self.stage(numbered(preprocess(fresh, cfg.preprocess, self.hook), "pos", txn.manifest["max_seq"]), "numbered"))
            fresh = self.stage(self._embedded(fresh, self.embedder), "fresh")
            top = fresh.agg(F.max("seq")).first()[0]
            if top is not None:
                self._place(txn, fresh, now)
                txn.manifest["max_seq"] = top
                txn.set_meta("model_id", self.embedder.model_id)
            if batch is not None:
                txn.manifest["batches"] = [*txn.manifest["batches"], batch][-1000:]
            results = self._results(rows, txn) if top is not None else self._results(rows, self.store.snapshot(), False)
            kept = self._keep(results, txn)
            self._commit(txn)
            return kept
        return self._keep(self._results(rows, self.store.snapshot(), False), txn)

    def _keep(self, results: DataFrame, txn: Transaction) -> DataFrame:
        path = f"{self.store.path}/_results/{txn.number:012d}-{uuid.uuid4().hex[:8]}"
        results.write.parquet(path)
        return self.spark.read.schema(results.schema).parquet(path).orderBy("pos")

    def _place(self, txn: Transaction, fresh: DataFrame, now: datetime) -> None:
        cfg = self.config
        txn.append("items", fresh)
        txn.append("vectors", fresh.select("id", "embedding", F.lit(self.embedder.model_id).alias("model_id"), F.lit(txn.number).alias("version")))
        decided = self._assign(fresh.select(F.col("id").alias("item_id"), "embedding"), txn, now)
        self._decisions = decided = self.stage(decided, "decisions")
        placed = fresh.join(decided.withColumnRenamed("item_id", "id"), "id")
        hit = F.col("cluster_id").isNotNull()
        txn.set_places(placed.select("id", F.when(hit, S.ASSIGNED).otherwise(S.BUFFERED).alias("status"), "cluster_id", F.lit(False).alias("locked"), F.when(hit, F.col("score")).alias("score")))
        arrivals = placed.where(hit)
        self._attach(txn, arrivals, now, F.col("seq"), score=F.col("score"))

    def _attach(self, txn: Transaction, arrivals: DataFrame, now: datetime, order: Column, **data: Any) -> None:
        """Move clusters and exemplars by arrivals (id, cluster_id, ts, seq, embedding); reopened, then assigned events in their order."""
        cfg, clusters = self.config, txn.table("clusters")
        exemplars = txn.table("exemplars")
        first = arrivals.groupBy("cluster_id").agg(F.min_by("id", "seq").alias("item_id"), F.min("seq").alias("seq"))
        opened = clusters.where(F.col("status") == S.CLOSED).join(first.withColumnRenamed("cluster_id", "id"), "id")
        events = _event("cluster.reopened", opened, F.col("seq"), F.lit(0), cluster=F.col("id"), item=F.col("item_id"), ts=now, size=F.col("size"), label=F.col("label"))
        events = events.unionByName(_event("item.assigned", arrivals, order, F.lit(1), cluster=F.col("cluster_id"), item=F.col("id"), ts=now, **data))
        txn.number_events(events, ["o0", "o1"])
        drawn = exemplars.select("cluster_id", "item_id", "embedding").unionByName(arrivals.select("cluster_id", F.col("id").alias("item_id"), "embedding"))
        txn.replace("exemplars", draw_exemplars(drawn, cfg.exemplars_per_cluster, cfg.random_seed))
        txn.replace("clusters", L.attach(clusters, arrivals))

    def _results(self, rows: DataFrame, snapshot: Snapshot, fresh: bool = True) -> DataFrame:
        none = lambda t: F.lit(None).cast(t)
        places = snapshot.places(rows).select(F.col("id"), F.col("cluster_id").alias("known_cluster"))
        first = first_of_each(rows, "id", "pos").withColumn("__first", F.lit(True))
        out = rows.select("id", "pos").join(first, ["id", "pos"], "left").join(places, "id", "left")
        if fresh:
            out = out.join(self._decisions.withColumnRenamed("item_id", "id").withColumn("__new", F.lit(True)), "id", "left")
            new = F.coalesce("__first", F.lit(False)) & F.coalesce("__new", F.lit(False))
        else:
            new = F.lit(False)
            out = out.select("*", none("string").alias("cluster_id"), none("double").alias("score"), none("string").alias("runner_up_cluster_id"), none("double").alias("runner_up_score"))
        pick = lambda c: F.when(new, F.col(c)).alias(c)
        return out.select("pos", F.col("id").alias("item_id"), F.when(new, F.col("cluster_id")).otherwise(F.col("known_cluster")).alias("cluster_id"), pick("score"), pick("runner_up_cluster_id"), pick("runner_up_score"), (~new).alias("duplicate"))

    # --- discovery ---------------------------------------------------------------------------------------------

    @_job
    def discover(self) -> DiscoveryReport:
        """Cluster the buffer: dense groups open clusters, fold into open ones they overlap, or are rejected as too loose; items that came
        meanwhile, or weren't in the sample, are matched to what was found."""
        if not self._discovering.acquire(blocking=False):
            return DiscoveryReport(0, skipped_reason="discovery is running")
        owner = uuid.uuid4().hex
        try:
            if not self.store.acquire_lock("discovery", owner, self.clock.now(), DISCOVERY_LOCK_TTL):
                return DiscoveryReport(0, skipped_reason="discovery is running elsewhere")
            try:
                return self._discover()
            finally:
                self.store.release_lock("discovery", owner)
        finally:
            self._discovering.release()

    def _buffered(self, snapshot: Snapshot) -> DataFrame:
        places = snapshot.places().where((F.col("status") == S.BUFFERED) & ~F.col("locked"))
        return snapshot.table("items").select("id", "seq", "ts").join(places.select("id", "score"), "id").join(snapshot.vectors(), "id")

    def _discover(self) -> DiscoveryReport:
        cfg, before = self.config, self.store.snapshot()
        waiting = self.stage(self._buffered(before), "buffer")
        size = waiting.count()
        if size < cfg.min_cluster_size:
            return DiscoveryReport(size, noise=size, skipped_reason="buffer too small")
        sample = D.fit_sample(waiting, cfg.discovery_sample_size, cfg.random_seed) if size > cfg.discovery_sample_size else waiting
        if cfg.reducer == "neighbours":
            placed = layout(sample.select("id", "embedding"), cfg.umap_components, cfg.umap_neighbors, seed=cfg.random_seed or 0)
            labels = D.groups(sample.drop("embedding").join(placed, "id"), cfg.min_cluster_size, cfg.min_samples, 1)  # as they are
        else:
            labels = D.groups(sample, cfg.min_cluster_size, cfg.min_samples, cfg.umap_components)
        labels = self.stage(labels, "labels")
        noise = labels.where("label < 0").count()
        return self._retry(lambda: self._open(labels, size, noise))

    def _open(self, labels: DataFrame, size: int, noise: int) -> DiscoveryReport:
        cfg, now, txn = self.config, self.clock.now(), self.store.transaction()
        waiting = self.stage(self._buffered(txn), "buffer")
        members = waiting.join(labels.where("label >= 0"), "id")
        large = members.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= cfg.min_cluster_size)
        members = self.stage(members.join(large.select("label"), "label"), "members")
        found, named, drawn = D.candidates(members, cfg.match_top_k, cfg.exemplars_per_cluster, cfg.threshold_percentile, cfg.threshold_bounds, cfg.random_seed)
        found, named, drawn = self.stage(found, "found"), self.stage(named, "named"), self.stage(drawn, "drawn")
        clusters, exemplars = txn.table("clusters"), txn.table("exemplars")
        live = clusters.where(F.col("status") == S.OPEN)
        fold_of = D.folds_in_order(found, named, drawn, live, exemplars, cfg.match_top_k, cfg.merge_threshold, cfg.exemplars_per_cluster, cfg.random_seed)
        folds = self.spark.createDataFrame(list(fold_of.items()), "id string, target string")  # candidates, not items
        rows = found.orderBy("min_seq").collect()
        rejected = [r.id for r in rows if r.id not in fold_of and r.cohesion < cfg.threshold_bounds[0]]
        new = [r for r in rows if r.id not in fold_of and r.id not in rejected]
        names = self._free_names(clusters, named, [r.id for r in new])
        moved = named.join(folds.withColumnRenamed("id", "cluster_id"), "cluster_id")
        if fold_of:
            arrivals = moved.select("id", F.col("target").alias("cluster_id"), "ts", "seq", "embedding", "score")
            self._attach(txn, arrivals, now, F.col("seq"), folded=True)
            txn.set_places(arrivals.select("id", F.lit(S.ASSIGNED).alias("status"), "cluster_id", F.lit(False).alias("locked"), "score"))
        reassigned = 0
        if new:
            self._create(txn, new, names, named, drawn, now)
        if new or fold_of:
            taken = named.join(found.select(F.col("id").alias("cluster_id")).where(~F.col("cluster_id").isin(rejected)) if rejected else found.select(F.col("id").alias("cluster_id")), "cluster_id").select("id")
            left = unknown(waiting, labels, "id").join(taken, "id", "left_anti")
            reassigned = self._reassign(txn, left, now)
        self._commit(txn) if new or fold_of else None
        return DiscoveryReport(size, tuple(names[r.id] for r in new), tuple(fold_of[r.id] for r in rows if r.id in fold_of), noise, reassigned, None, len(rejected))

    def _free_names(self, clusters: DataFrame, named: DataFrame, ids: list[str]) -> dict[str, str]:
        """A name for each candidate; one that a cluster had before is salted until it is free."""
        taken = {r.id for r in clusters.join(self.spark.createDataFrame([(i,) for i in ids], "id string"), "id").select("id").collect()} if ids else set()
        names = {}
        for i in ids:
            name, salt = i, 0
            if i in taken:
                founders = [r.id for r in named.where(F.col("cluster_id") == i).select("id").collect()]  # one cluster's, of a bounded sample
                while clusters.where(F.col("id") == name).limit(1).count():
                    salt += 1
                    name = cluster_id_of(founders, f"#{salt}")
            names[i] = name
        return names

    def _create(self, txn: Transaction, new: list, names: dict[str, str], named: DataFrame, drawn: DataFrame, now: datetime) -> None:
        rows = [(r.id, names[r.id], i) for i, r in enumerate(new)]
        rename = self.spark.createDataFrame(rows, "cluster_id string, name string, nth int")
        made = [(names[r.id], S.OPEN, r.threshold, r.size, r.first_seen, r.last_seen, now, None, None, None, False, r.size, r.size) for r in new]
        clusters = self.spark.createDataFrame(made, S.CLUSTERS)
        everyone = named.join(F.broadcast(rename), "cluster_id").select("id", F.col("name").alias("cluster_id"), "nth", "seq")
        txn.set_places(everyone.select("id", F.lit(S.ASSIGNED).alias("status"), "cluster_id", F.lit(False).alias("locked"), F.lit(None).cast("double").alias("score")))
        mine = drawn.join(F.broadcast(rename), "cluster_id").select(F.col("name").alias("cluster_id"), "pos", "item_id", "embedding")
        txn.append("exemplars", mine)
        txn.add_clusters(clusters)
        labelled = self._label(txn, [names[r.id] for r in new])
        rows = txn.table("clusters").join(F.broadcast(rename.select(F.col("name").alias("id"), "nth")), "id")
        events = _event("cluster.opened", rows, F.col("nth"), F.lit(0).cast("long"), cluster=F.col("id"), ts=now, size=F.col("size"), threshold=F.col("threshold"), label=F.col("label"))
        events = events.unionByName(_event("item.assigned", everyone, F.col("nth"), F.col("seq"), cluster=F.col("cluster_id"), item=F.col("id"), ts=now, discovered=True))
        txn.number_events(events, ["o0", "o1"])
        log.info("opened %d clusters, labelled %d", len(new), labelled)

    def _reassign(self, txn: Transaction, left: DataFrame, now: datetime) -> int:
        decided = self._assign(left.select(F.col("id").alias("item_id"), "embedding"), txn, now).where("cluster_id is not null")
        hits = self.stage(left.drop("score").join(decided.select(F.col("item_id").alias("id"), "cluster_id", "score"), "id"), "reassigned")
        n = hits.count()
        if n:
            txn.set_places(hits.select("id", F.lit(S.ASSIGNED).alias("status"), "cluster_id", F.lit(False).alias("locked"), "score"))
            self._attach(txn, hits, now, F.col("seq"), score=F.col("score"), reassigned=True)
        return n

    # --- labels ------------------------------------------------------------------------------------------------

    def _ctfidf(self, texts: DataFrame, targets: DataFrame) -> DataFrame:
        return ctfidf_labels(texts, n=self.config.label_terms, targets=targets)

    def _texts(self, snapshot: Snapshot, statuses: tuple[str, ...]) -> DataFrame:
        live = snapshot.table("clusters").where(F.col("status").isin(*statuses)).select(F.col("id").alias("cluster_id"))
        members = snapshot.table("items").join(snapshot.places().where("cluster_id is not null").select("id", "cluster_id"), "id").join(live, "cluster_id")
        newest = sampling.recent(members.withColumnRenamed("id", "item_id"), LABEL_NEWEST).drop("rank")
        return sampling.random(newest, LABEL_TEXTS, self.config.random_seed).select("cluster_id", F.col("seq").alias("pos"), "text")

    def _label(self, txn: Transaction, ids: list[str]) -> int:
        """New labels for clusters, in contrast to all live ones. A labeler that fails leaves the labels as they are."""
        targets = self.spark.createDataFrame([(i,) for i in ids], "cluster_id string")
        try:
            fresh = self.stage(self.labeler(self._texts(txn, (S.OPEN, S.CLOSED)), targets), "labels")
        except Exception:
            log.exception("the labeler failed")
            return 0
        clusters = txn.table("clusters").join(fresh.select(F.col("cluster_id").alias("id"), F.col("label").alias("__label")), "id", "left").join(targets.select(F.col("cluster_id").alias("id"), F.lit(True).alias("__hit")), "id", "left")
        txn.replace("clusters", clusters.select(*(F.coalesce("__label", "label").alias(c) if c == "label" else F.when(F.col("__hit"), F.col("size")).otherwise(F.col(c)).alias(c) if c == "label_size" else F.col(c) for c in S.CLUSTERS.names)))
        return fresh.count()

    # --- sweep -------------------------------------------------------------------------------------------------

    @_job
    def sweep(self) -> SweepReport:
        """Close quiet clusters, archive expired ones, merge alike ones, orphan stale items, relabel grown clusters; in this order, one commit."""
        return self._retry(self._sweep)

    def _sweep(self) -> SweepReport:
        cfg, now, txn = self.config, self.clock.now(), self.store.transaction()
        clusters = txn.table("clusters")
        order = [F.col("opened_at"), F.col("id")]
        times = None
        if cfg.keep_open_min_items > 1:
            times = txn.places().where("cluster_id is not null").select("id", "cluster_id").join(txn.table("items").select("id", "ts"), "id")
        quiet = self.stage(L.quiet(clusters, times, now, cfg.close_after, cfg.keep_open_min_items), "quiet")
        closed = tuple(r.id for r in quiet.orderBy(*order).select("id").collect())
        events = [_event("cluster.closed", quiet, F.lit(0), *order, cluster=F.col("id"), ts=now, size=F.col("size"), label=F.col("label"), last_seen=F.date_format("last_seen", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))]
        clusters = L.close(clusters, quiet, now)
        over = self.stage(L.expired(clusters, now, cfg.grace), "expired")
        archived = tuple(r.id for r in over.orderBy(*order).select("id").collect())
        events.append(_event("cluster.archived", over, F.lit(1), *order, cluster=F.col("id"), ts=now, size=F.col("size"), label=F.col("label")))
        if closed or archived:
            clusters = txn.replace("clusters", L.archive(clusters, over))
        merged = self._merge_alike(txn, now, events)
        stale = self.stage(L.stale(txn.table("items").select("id", "seq", "ts").join(txn.places(), "id"), now, cfg.buffer_max_age), "stale")
        orphaned = stale.count()
        if orphaned:
            txn.set_places(stale.select("id", F.lit(S.ORPHANED).alias("status"), "cluster_id", "locked", "score"))
            events.append(_event("item.orphaned", stale, F.lit(3), F.lit(now), F.format_string("%020d", "seq"), item=F.col("id"), ts=now, timestamp=F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")))
        relabeled = self._relabel(txn, now, events)
        report = SweepReport(closed, archived, tuple((a, s) for a, s, _ in merged), orphaned, relabeled)
        if closed or archived or merged or orphaned or txn.manifest["tables"] != self.store.manifest(txn.number - 1)["tables"]:
            every = events[0]
            for e in events[1:]:
                every = every.unionByName(e)
            txn.number_events(every.withColumn("o2", F.col("o2").cast("string")), ["o0", "o1", "o2"])
            self._commit(txn)
        return report

    def _merge_alike(self, txn: Transaction, now: datetime, events: list[DataFrame]) -> list[tuple[str, str, float]]:
        cfg, clusters = self.config, txn.table("clusters")
        able = clusters.where((F.col("status") == S.OPEN) & ~F.col("status_locked"))
        pairs = L.merge_candidates(able, txn.table("exemplars"), txn.table("no_merge"), cfg.merge_threshold, cfg.match_top_k)
        chosen = L.greedy_pairs(pairs)
        told = L.survivors(chosen, clusters).join(chosen, ["a", "b"]).orderBy(F.desc("similarity"), "a", "b").select("absorbed", "survivor", "similarity")
        merges = [tuple(r) for r in told.collect()]  # clusters that are merged in this sweep
        if not merges:
            return []
        self._merge(txn, merges, now, events, manual=False)
        return merges

    def _merge(self, txn: Transaction, merges: list[tuple[str, str, float | None]], now: datetime, events: list[DataFrame] | None, manual: bool) -> None:
        """Absorbed clusters give members, exemplars and counts to their survivors and point to them."""
        cfg, clusters = self.config, self.stage(txn.table("clusters"), "clusters")
        pairs = self.spark.createDataFrame([(a, s, x, i) for i, (a, s, x) in enumerate(merges)], "absorbed string, survivor string, similarity double, nth int")
        places = txn.places().where("cluster_id is not null")
        moved = self.stage(places.join(pairs, places["cluster_id"] == F.col("absorbed")).select("id", "status", F.col("survivor").alias("cluster_id"), "locked", "score", "absorbed"), "moved")
        counts = moved.groupBy("absorbed").agg(F.count("*").alias("moved"))
        txn.set_places(moved.drop("absorbed"))
        gone = clusters.join(pairs, clusters["id"] == F.col("absorbed")).select(F.col("survivor").alias("id"), *(F.col(c).alias(f"g_{c}") for c in ("size", "seen_count", "threshold", "first_seen", "last_seen")))
        gain = gone.groupBy("id").agg(F.sum("g_size").alias("g_size"), F.sum("g_seen_count").alias("g_seen"), F.min("g_threshold").alias("g_threshold"), F.min("g_first_seen").alias("g_first"), F.max("g_last_seen").alias("g_last"))
        pointer = pairs.select(F.col("absorbed").alias("id"), F.col("survivor").alias("__to"))
        both = clusters.join(gain, "id", "left").join(pointer, "id", "left")
        out = F.col("__to").isNotNull()
        values = {
            "status": F.when(out, S.MERGED).otherwise(F.col("status")),
            "merged_into": F.coalesce("__to", "merged_into"),
            "closed_at": F.when(out, F.lit(now)).otherwise(F.col("closed_at")),
            "size": F.when(out, 0).otherwise(F.col("size") + F.coalesce("g_size", F.lit(0))),
            "seen_count": F.col("seen_count") + F.coalesce("g_seen", F.lit(0)),
            "threshold": F.least("threshold", "g_threshold"),
            "first_seen": F.least("first_seen", "g_first"),
            "last_seen": F.greatest("last_seen", "g_last"),
        }
        txn.replace("clusters", both.select(*(values.get(c, F.col(c)).alias(c) for c in S.CLUSTERS.names)))
        exemplars = txn.table("exemplars")
        pooled = exemplars.join(pairs, exemplars["cluster_id"] == F.col("absorbed"), "left").select(F.coalesce("survivor", "cluster_id").alias("cluster_id"), "item_id", "embedding")
        txn.replace("exemplars", draw_exemplars(pooled, cfg.exemplars_per_cluster, cfg.random_seed))
        told = pairs.join(counts, "absorbed", "left")
        rows = _event("cluster.merged", told, F.lit(2), F.lit(now), F.format_string("%020d", "nth"), cluster=F.col("absorbed"), ts=now, survivor=F.col("survivor"), moved=F.coalesce("moved", F.lit(0)), similarity=F.round("similarity", 6), **({"manual": True} if manual else {}))
        if events is None:
            txn.number_events(rows, ["o0", "o1", "o2"])
        else:
            events.append(rows)

    def _relabel(self, txn: Transaction, now: datetime, events: list[DataFrame]) -> tuple[str, ...]:
        due = L.grown(txn.table("clusters"), self.config.relabel_growth).orderBy("opened_at", "id").select("id", "label").collect()
        if not due:
            return ()
        old = self.spark.createDataFrame([(r.id, r.label) for r in due], "id string, previous string")
        self._label(txn, [r.id for r in due])
        changed = self.stage(txn.table("clusters").join(old, "id").where(~F.col("label").eqNullSafe(F.col("previous"))), "relabeled")
        events.append(_event("cluster.relabeled", changed, F.lit(4), F.col("opened_at"), F.col("id"), cluster=F.col("id"), ts=now, label=F.col("label"), previous=F.col("previous")))
        return tuple(r.id for r in changed.orderBy("opened_at", "id").select("id").collect())

    # --- overrides ---------------------------------------------------------------------------------------------

    def _cluster(self, snapshot: Snapshot, cluster_id: str, *statuses: str):
        found = snapshot.table("clusters").where(F.col("id") == cluster_id).collect()
        if not found:
            raise KeyError(f"unknown cluster {cluster_id}")
        if statuses and found[0].status not in statuses:
            raise ValueError(f"cluster {cluster_id} is {found[0].status}, not {' or '.join(statuses)}")
        return found[0]

    def _set(self, txn: Transaction, cluster_id: str, **values: Any) -> None:
        clusters = txn.table("clusters")
        hit = F.col("id") == cluster_id
        txn.replace("clusters", clusters.select(*((F.when(hit, v if isinstance(v := values[c], Column) else F.lit(v)).otherwise(F.col(c)) if c in values else F.col(c)).cast(clusters.schema[c].dataType).alias(c) for c in S.CLUSTERS.names)))

    def _refresh(self, txn: Transaction, *cluster_ids: str) -> None:
        """Exemplars, threshold, size and times anew from the members; the threshold stays where there is one exemplar at most."""
        cfg = self.config
        places = txn.places().where(F.col("cluster_id").isin(*cluster_ids)).select("id", "cluster_id")
        members = self.stage(txn.table("items").select("id", "ts").join(places, "id").join(txn.vectors(), "id").withColumnRenamed("id", "item_id"), "refresh")
        drawn = self.stage(draw_exemplars(members, cfg.exemplars_per_cluster, cfg.random_seed), "drawn")
        limits = thresholds(member_scores(members, drawn, cfg.match_top_k), cfg.threshold_percentile, *cfg.threshold_bounds)
        many = drawn.groupBy("cluster_id").agg(F.count("*").alias("__drawn"))
        stats = members.groupBy("cluster_id").agg(F.count("*").alias("__n"), F.min("ts").alias("__first"), F.max("ts").alias("__last")).join(limits, "cluster_id").join(many, "cluster_id").select(F.col("cluster_id").alias("id"), "__n", "__first", "__last", "__drawn", F.round("threshold", 6).alias("__threshold"))
        clusters = txn.table("clusters")
        mine = F.col("id").isin(*cluster_ids)
        values = {
            "size": F.when(mine, F.coalesce("__n", F.lit(0))).otherwise(F.col("size")),
            "threshold": F.when(F.col("__drawn") > 1, F.col("__threshold")).otherwise(F.col("threshold")),
            "first_seen": F.coalesce("__first", "first_seen"),
            "last_seen": F.coalesce("__last", "last_seen"),
        }
        txn.replace("clusters", clusters.join(stats, "id", "left").select(*(values.get(c, F.col(c)).alias(c) for c in S.CLUSTERS.names)))
        txn.replace("exemplars", txn.table("exemplars").where(~F.col("cluster_id").isin(*cluster_ids)).unionByName(drawn))

    @_job
    def move_item(self, item_id: str, cluster_id: str) -> None:
        """Put an item into a cluster for good: it is locked there. An item that is there already is locked only."""
        now, txn = self.clock.now(), self.store.transaction()
        target = self._cluster(txn, cluster_id, S.OPEN, S.CLOSED)
        place = txn.places().where(F.col("id") == item_id).collect()
        if not place:
            raise KeyError(f"unknown item {item_id}")
        source = place[0].cluster_id
        same = source == cluster_id
        row = (item_id, S.ASSIGNED, cluster_id, True, place[0].score if same else None)
        txn.set_places(self.spark.createDataFrame([row], "id string, status string, cluster_id string, locked boolean, score double"))
        if not same:
            self._set(txn, cluster_id, seen_count=target.seen_count + 1)
            self._refresh(txn, *([source] if source else []), cluster_id)
            one = self.spark.createDataFrame([(item_id, source)], "id string, previous string")
            txn.number_events(_event("item.moved", one, F.lit(0), cluster=F.lit(cluster_id), item=F.col("id"), ts=now, previous=F.col("previous"), manual=True), ["o0"])
        self._commit(txn)

    @_job
    def merge_clusters(self, a: str, b: str, survivor: str | None = None) -> str:
        """Merge two clusters by hand; returns the survivor. An open cluster absorbed by a closed one opens it."""
        if a == b:
            raise ValueError("a cluster can't be merged with itself")
        if survivor not in (None, a, b):
            raise ValueError(f"the survivor must be {a} or {b}")
        now, txn = self.clock.now(), self.store.transaction()
        rows = [self._cluster(txn, c, S.OPEN, S.CLOSED) for c in (a, b)]
        best = min(rows, key=lambda r: (-r.size, r.opened_at, r.id)) if survivor is None else next(r for r in rows if r.id == survivor)
        gone = next(r for r in rows if r.id != best.id)
        if gone.status == S.OPEN and best.status == S.CLOSED:
            self._set(txn, best.id, status=S.OPEN, closed_at=None)
        self._merge(txn, [(gone.id, best.id, None)], now, None, manual=True)
        self._commit(txn)
        return best.id

    @_job
    def split_cluster(self, cluster_id: str, item_ids: Iterable[str]) -> str:
        """Make a new cluster of some members, locked there; the two never merge on their own again. Returns its name."""
        ids = list(dict.fromkeys(item_ids))
        now, txn, cfg = self.clock.now(), self.store.transaction(), self.config
        source = self._cluster(txn, cluster_id, S.OPEN, S.CLOSED)
        wanted = self.spark.createDataFrame([(i,) for i in ids], "id string")
        have = txn.places().where(F.col("cluster_id") == cluster_id)
        members = {r.id for r in have.join(wanted, "id").select("id").collect()}
        if not ids or members != set(ids):
            raise ValueError("items to split off must be members of the cluster")
        if have.count() <= len(ids):
            raise ValueError("at least one member must remain")
        name, salt = cluster_id_of(ids), 0
        while txn.table("clusters").where(F.col("id") == name).limit(1).count():
            salt += 1
            name = cluster_id_of(ids, f"#{salt}")
        low = cfg.threshold_bounds[0]
        times = txn.table("items").join(wanted, "id").agg(F.min("ts").alias("a"), F.max("ts").alias("b")).first()
        txn.add_clusters(self.spark.createDataFrame([(name, S.OPEN, low, len(ids), times.a, times.b, now, None, None, None, False, len(ids), len(ids))], S.CLUSTERS))
        txn.set_places(have.join(wanted, "id").select("id", F.lit(S.ASSIGNED).alias("status"), F.lit(name).alias("cluster_id"), F.lit(True).alias("locked"), F.lit(None).cast("double").alias("score")))
        self._refresh(txn, cluster_id, name)
        txn.append("no_merge", self.spark.createDataFrame([tuple(sorted((cluster_id, name)))], S.NO_MERGE))
        self._label(txn, [cluster_id, name])
        made = txn.table("clusters").where(F.col("id") == name)
        one = self.spark.createDataFrame([(source.id,)], "id string")
        events = _event("cluster.split", one, F.lit(0), cluster=F.col("id"), ts=now, new_cluster=name, moved=len(ids), manual=True)
        events = events.unionByName(_event("cluster.opened", made, F.lit(1), cluster=F.col("id"), ts=now, size=F.col("size"), threshold=F.col("threshold"), label=F.col("label"), split_from=cluster_id))
        txn.number_events(events, ["o0"])
        self._commit(txn)
        return name

    @_job
    def _set_status(self, cluster_id: str, status: str, allowed: tuple[str, ...], kind: str) -> None:
        now, txn = self.clock.now(), self.store.transaction()
        was = self._cluster(txn, cluster_id, *allowed)
        closed_at = None if status == S.OPEN else (was.closed_at if was.status == S.CLOSED else now)
        self._set(txn, cluster_id, status=status, closed_at=closed_at, status_locked=True)
        if was.status != status:
            row = txn.table("clusters").where(F.col("id") == cluster_id)
            txn.number_events(_event(kind, row, F.lit(0), cluster=F.col("id"), ts=now, size=F.col("size"), label=F.col("label"), manual=True), ["o0"])
        self._commit(txn)

    def close_cluster(self, cluster_id: str) -> None:
        """Close by hand; matches don't reopen it."""
        self._set_status(cluster_id, S.CLOSED, (S.OPEN, S.CLOSED), "cluster.closed")

    def reopen_cluster(self, cluster_id: str) -> None:
        """Reopen by hand, archived ones too; sweeps neither close nor merge it."""
        self._set_status(cluster_id, S.OPEN, (S.OPEN, S.CLOSED, S.ARCHIVED), "cluster.reopened")

    @_job
    def unlock_cluster(self, cluster_id: str) -> None:
        txn = self.store.transaction()
        self._cluster(txn, cluster_id)
        self._set(txn, cluster_id, status_locked=False)
        self._commit(txn)

    # --- migration ---------------------------------------------------------------------------------------------

    @_job
    def reembed(self, embedder: Embedder) -> int:
        """All items under another model: new vectors, exemplars and thresholds in one commit. Returns the number of items."""
        cfg, txn = self.config, self.store.transaction()
        fresh = txn.append("vectors", self._embedded(txn.table("items").select("id", "text"), embedder).select("id", "embedding", F.lit(embedder.model_id).alias("model_id"), F.lit(txn.number).alias("version")))
        vectors = fresh.select("id", "embedding")
        kept = txn.table("exemplars").drop("embedding").join(vectors.withColumnRenamed("id", "item_id"), "item_id").select("cluster_id", "pos", "item_id", "embedding")
        exemplars = txn.replace("exemplars", kept)
        members = txn.places().where("cluster_id is not null").select(F.col("id").alias("item_id"), "cluster_id").join(vectors.withColumnRenamed("id", "item_id"), "item_id")
        limits = thresholds(member_scores(members, exemplars, cfg.match_top_k), cfg.threshold_percentile, *cfg.threshold_bounds).select(F.col("cluster_id").alias("id"), F.round("threshold", 6).alias("__t"))
        clusters = txn.table("clusters").join(limits, "id", "left")
        txn.replace("clusters", clusters.select(*(F.coalesce("__t", "threshold").alias(c) if c == "threshold" else F.col(c) for c in S.CLUSTERS.names)))
        txn.set_meta("model_id", embedder.model_id)
        self._commit(txn)
        self.embedder = embedder
        return fresh.count()

    # --- reading -----------------------------------------------------------------------------------------------

    def buffer_size(self) -> int:
        return self.store.snapshot().places().where(F.col("status") == S.BUFFERED).count()

    def clusters(self, *statuses: str) -> DataFrame:
        """Clusters in the order in which they were opened, of some statuses or all."""
        rows = self.store.snapshot().table("clusters")
        return (rows.where(F.col("status").isin(*statuses)) if statuses else rows).orderBy("opened_at", "id")

    def get_cluster(self, cluster_id: str) -> dict[str, Any]:
        return self._cluster(self.store.snapshot(), cluster_id).asDict()

    def resolve(self, cluster_id: str) -> str:
        """Where a cluster's merge pointers lead."""
        snapshot, seen = self.store.snapshot(), set()
        row = self._cluster(snapshot, cluster_id)
        while row.merged_into and row.id not in seen:
            seen.add(row.id)
            row = self._cluster(snapshot, row.merged_into)
        return row.id

    def members(self, cluster_id: str, snapshot: Snapshot | None = None) -> DataFrame:
        s = snapshot or self.store.snapshot()
        mine = s.places().where(F.col("cluster_id") == cluster_id).select("id", "cluster_id", "locked", "score")
        return s.table("items").join(mine, "id").join(s.vectors(), "id", "left").withColumnRenamed("id", "item_id")

    def sample(self, cluster_id: str, n: int = 10, strategy: str = "mixed") -> DataFrame:
        self._cluster(self.store.snapshot(), cluster_id)
        return sampling.sample(self.members(cluster_id), n, strategy, self.config.random_seed).orderBy("rank")

    def cluster_detail(self, cluster_id: str, n: int = 10, bucket: timedelta | None = None) -> ClusterDetail:
        cluster = self.get_cluster(cluster_id)
        micros = int(bucket.total_seconds() * 1_000_000) if bucket else None
        return ClusterDetail(cluster, sampling.counts_over_time(self.members(cluster_id), "cluster_id", micros).orderBy("bucket_start"), self.sample(cluster_id, n))

    def events(self, after: int = 0, limit: int | None = None) -> DataFrame:
        return self.store.snapshot().events(after, limit)

    def stats(self) -> dict[str, dict[str, int]]:
        s = self.store.snapshot()
        counts = lambda rows, known: {r.status: r.n for r in status_counts(rows, known).collect()}
        return {"items": counts(s.places(), S.ITEM_STATUSES), "clusters": counts(s.table("clusters"), S.CLUSTER_STATUSES)}

    def close(self) -> None:
        """Close the sinks and wait for the deliveries that were begun."""
        if self._posting:
            self._posting.shutdown(wait=True)
            for post in self._posts:
                if post.exception():
                    log.error("a delivery failed: %s", post.exception())
        self.bus.close()
