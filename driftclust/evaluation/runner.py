"""Labelled replay, tuning and timings."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import timedelta
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftclust.clock import SimulatedClock
from driftclust.config import Config
from driftclust.engine import ClusteringEngine, Item
from driftclust.evaluation.metrics import summary
from driftclust.functions.embed import make_embedder
from driftclust.functions.memory import VectorMemory
from driftclust.functions.text import preprocess
from driftclust.schema import CLUSTERS, OPEN
from driftclust.session import shared_folder
from driftclust.sources.synthetic import START, texts
from driftclust.streaming.replay import ReplayStats, replay


@dataclass
class EvalResult:
    metrics: dict[str, Any]
    stats: ReplayStats
    engine: ClusteringEngine


def run_eval(spark: SparkSession, items: DataFrame, config: Config, *, drain: timedelta | None = None, window: timedelta = timedelta(minutes=5), most: int = 256, speed: float = 0.0, store: str = "memory://") -> EvalResult:
    """Replay items (id, text, ts, label) into a new engine and measure the result against the labels. ``speed`` paces the replay, in simulated seconds to a
    real one."""
    if not items.where("label is not null").limit(1).count():
        raise ValueError("an evaluation needs labelled items")
    first = items.agg(F.min("ts")).first()[0]
    engine = ClusteringEngine(spark, config.with_values(store=store), clock=SimulatedClock(first))
    stats = replay(engine, items, drain=config.close_after + 2 * config.sweep_interval if drain is None else drain, window=window, most=most, speed=speed)
    s = engine.store.snapshot()
    judged = s.items().join(items.where("label is not null").select("id", "label"), "id")
    row = summary(judged, s.table("clusters"), s.table("events")).first().asDict()
    ms = {f"batch_p{p}_ms": None if (x := stats.latency(p)) is None else round(1000 * x, 1) for p in (50, 95)}
    return EvalResult({**row, "items_per_second": round(stats.items_per_second, 1), **ms}, stats, engine)


def default_grid(config: Config) -> dict[str, list]:
    """Values about the configured ones."""
    low, high = config.threshold_bounds
    return {
        "threshold_percentile": [5.0, 10.0],
        "threshold_bounds": [(round(low + d, 4), high) for d in (-0.03, 0.0, 0.03) if 0 < low + d <= high],
        "merge_threshold": [round(config.merge_threshold + d, 4) for d in (-0.03, 0.0, 0.03)],
    }


@dataclass
class Trial:
    params: dict[str, Any]
    metrics: dict[str, Any]
    pareto: bool = False


def mark_front(trials: list[Trial]) -> list[Trial]:
    """Trials that no other beats in false merges and fragmentation."""
    cost = lambda t: (t.metrics["false_merge_rate"] or 0.0, t.metrics["fragmentation"] or 0.0)
    for t in trials:
        a = cost(t)
        t.pareto = not any(b != a and b[0] <= a[0] and b[1] <= a[1] for b in map(cost, trials))
    return sorted(trials, key=lambda t: (*cost(t), sorted(map(str, t.params.items()))))


def tune(spark: SparkSession, items: DataFrame, config: Config, grid: dict[str, Iterable] | None = None, on_trial: Callable[[Trial], None] | None = None, **how) -> list[Trial]:
    """An evaluation for each combination of values; the front of the trade-off is marked. All texts are embedded once, before the first one."""
    grid = grid or default_grid(config)
    if config.vector_memory is None:
        config = config.with_values(vector_memory=f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}")
    if "embedder" not in grid and "preprocess" not in grid:
        texts = preprocess(items.select("text").distinct(), config.preprocess)
        VectorMemory(spark, config.vector_memory, make_embedder(config.embedder, config.model_dir)).embed(texts, config.embed_batch_size).count()
    trials = []
    for values in itertools.product(*grid.values()):
        params = dict(zip(grid, values, strict=True))
        trial = Trial(params, run_eval(spark, items, config.with_values(**params), **how).metrics)
        trials.append(trial)
        if on_trial:
            on_trial(trial)
    return mark_front(trials)


def _seeded(spark: SparkSession, clusters: int, exemplars: int, dim: int, seed: int) -> ClusteringEngine:
    """An engine with open clusters of random exemplars."""
    r = np.random.default_rng(seed)
    vectors = r.normal(size=(clusters * exemplars, dim)).astype(np.float32)
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    n = np.arange(len(vectors))
    column = pa.ListArray.from_arrays(np.arange(len(vectors) + 1, dtype=np.int32) * dim, vectors.ravel())
    engine = ClusteringEngine(spark, Config(embedder=f"hashing:{dim}", threshold_bounds=(0.3, 0.95)), clock=SimulatedClock(START))
    txn = engine.store.transaction()
    txn.append("exemplars", spark.createDataFrame(pa.table({"cluster_id": [f"c{i}" for i in n // exemplars], "pos": (n % exemplars).astype(np.int32), "item_id": [f"x{i}" for i in n], "embedding": column})))
    txn.append("clusters", spark.createDataFrame([(f"c{i}", OPEN, 0.3, exemplars, START, START, START, None, None, None, False, exemplars, exemplars) for i in range(clusters)], CLUSTERS))
    txn.commit()
    return engine


def _timed(job: Callable[[], Any]) -> tuple[float, Any]:
    began = time.perf_counter()
    found = job()
    return time.perf_counter() - began, found


def measure(spark: SparkSession, clusters: int = 1000, exemplars: int = 32, dim: int = 256, batch: int = 20_000, buffer: int = 20_000, singles: int = 5, seed: int = 7) -> dict[str, float]:
    """Seconds and rates of whole jobs: ``ingest`` of a batch of short texts (embedding, decisions and commit) against clusters, ``match`` and
    ``ingest`` of single items, and ``discover`` on a buffer."""
    engine = _seeded(spark, clusters, exemplars, dim, seed)
    rows = lambda n, s, name: spark.createDataFrame([(f"{name}{i}", t, START + timedelta(seconds=i)) for i, t in enumerate(texts(n, s))], "id string, text string, ts timestamp")
    bulk, _ = _timed(lambda: engine.ingest(rows(batch, seed, "b")))
    some = [Item(f"s{i}", t, START) for i, t in enumerate(texts(2 * singles + 1, seed + 1))]
    engine.match(some[:1]).collect()
    matched = [_timed(lambda item=item: engine.match([item]).collect())[0] for item in some[1 : singles + 1]]
    ingested = [_timed(lambda item=item: engine.ingest([item]))[0] for item in some[singles + 1 :]]
    other = ClusteringEngine(spark, Config(embedder=f"hashing:{dim}", threshold_bounds=(0.3, 0.95)), clock=SimulatedClock(START))
    other.ingest(rows(buffer, seed, "d"))
    found, report = _timed(other.discover)
    engine.store.truncate(), other.store.truncate()
    ms = lambda values, p: round(float(np.percentile(values, p)) * 1000, 1)
    return {
        "ingest_items_per_second": round(batch / bulk, 1),
        "ingest_seconds": round(bulk, 3),
        "match_p50_ms": ms(matched, 50),
        "match_p95_ms": ms(matched, 95),
        "ingest_one_p50_ms": ms(ingested, 50),
        "discovery_seconds": round(found, 2),
        "discovery_clusters": len(report.opened),
        "discovery_buffer": report.snapshot_size,
    }


__all__ = ["START", "Item", "EvalResult", "Trial", "default_grid", "mark_front", "measure", "run_eval", "tune"]
