"""Command line: ``python -m driftclust.cli --store PATH COMMAND``."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from datetime import timedelta
from typing import Any

from driftclust.config import Config, load_config, parse_duration
from driftclust.engine import ClusteringEngine
from driftclust.events import Event, EventRoutes, TerminalSink, describe
from driftclust.service import Service, plain, server
from driftclust.session import session


def build_engine(config: Config, spark=None, clock=None, terminal: bool = False) -> ClusteringEngine:
    """An engine with the configured sinks."""
    bus = EventRoutes()
    if terminal:
        bus.route(TerminalSink())
    return ClusteringEngine(spark or session(), config, bus=bus, clock=clock)


def _print(value: Any, as_json: bool) -> None:
    value = plain(value)
    if as_json or not isinstance(value, list) or not value or not isinstance(value[0], dict):
        print(json.dumps(value, indent=2, default=str, ensure_ascii=False))
        return
    names = list(value[0])
    rows = [[("" if r[n] is None else str(r[n]))[:60] for n in names] for r in value]
    widths = [max(len(n), *(len(r[i]) for r in rows)) for i, n in enumerate(names)]
    for line in [names, *rows]:
        print("  ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="driftclust", description=__doc__)
    p.add_argument("--config", "-c")
    p.add_argument("--store")
    p.add_argument("--embedder")
    p.add_argument("--model-dir")
    p.add_argument("--log-level", default="WARNING")
    p.add_argument("--json", action="store_true")
    s = p.add_subparsers(dest="command", required=True)
    add = lambda name, *args: [s.add_parser(name)] and [s.choices[name].add_argument(*a[0], **a[1]) for a in args]
    arg = lambda *names, **how: (names, how)
    add("ingest", arg("file"), arg("--discover", action="store_true"))
    add("discover")
    add("sweep")
    add("clusters", arg("--status", action="append", default=[]))
    add("show", arg("cluster"), arg("--sample-size", type=int, default=10), arg("--bucket"))
    add("sample", arg("cluster"), arg("-n", type=int, default=10), arg("--strategy", default="mixed"))
    add("events", arg("--after", type=int, default=0), arg("--limit", type=int, default=100), arg("--items", action="store_true"))
    add("stats")
    add("reembed", arg("--to", required=True))
    add("serve", arg("--host", default="127.0.0.1"), arg("--port", type=int, default=8000), arg("--api-key"))
    add("move", arg("item"), arg("cluster"))
    add("merge", arg("a"), arg("b"), arg("--survivor"))
    add("split", arg("cluster"), arg("items", nargs="+"))
    for name in ("close", "reopen", "unlock"):
        add(name, arg("cluster"))
    add("eval", arg("file"), arg("--drain"))
    add("tune", arg("file"), arg("--percentile", type=float, action="append"), arg("--merge", type=float, action="append"))
    add("bench", arg("--clusters", type=int, default=1000), arg("--items", type=int, default=20_000))
    add("demo", arg("--report"), arg("--speed", type=float, default=0.0), arg("--per-topic", type=int, default=190))
    add("report", arg("out"))
    return p


def run(a: argparse.Namespace, spark=None) -> Any:
    """The result of a command; KeyError and ValueError for what a user can mend."""
    config = load_config(a.config, store=a.store, embedder=a.embedder, model_dir=a.model_dir)
    spark = spark or session()
    if a.command in ("eval", "tune", "bench", "demo"):
        return _evaluate(a, config, spark)
    if a.command == "reembed":
        from driftclust.functions.embed import make_embedder
        from driftclust.state.store import StateStore

        store = StateStore.open(spark, config.store)
        old = store.snapshot().meta("model_id")
        engine = ClusteringEngine(spark, config, store=store, embedder=_Stored(old) if old else None)
        return {"items": engine.reembed(make_embedder(a.to, config.model_dir)), "model": a.to}
    engine = build_engine(config, spark)
    try:
        return _command(a, engine)
    finally:
        engine.close()


class _Stored:
    """Stands for the model of stored vectors, which a migration needn't run."""

    def __init__(self, model_id: str):
        self.model_id = model_id

    def embed(self, texts):
        raise RuntimeError("the old model isn't loaded")


def _command(a: argparse.Namespace, e: ClusteringEngine) -> Any:
    if a.command == "ingest":
        from driftclust.sources.files import read_items

        results = e.ingest(read_items(e.spark, a.file, e.config.columns))
        out = {k: 0 for k in ("assigned", "buffered", "duplicate")}
        for r in results.selectExpr("case when duplicate then 'duplicate' when cluster_id is null then 'buffered' else 'assigned' end as outcome").groupBy("outcome").count().collect():
            out[r.outcome] = r["count"]
        return {**out, **({"discovery": plain(e.discover())} if a.discover else {})}
    if a.command == "clusters":
        return e.clusters(*a.status).select("id", "status", "size", "label", "first_seen", "last_seen", "threshold").collect()
    if a.command == "show":
        d = e.cluster_detail(a.cluster, a.sample_size, parse_duration(a.bucket) if a.bucket else None)
        return {"cluster": d.cluster, "counts_over_time": d.counts_over_time.collect(), "sample": d.sample.select("item_id", "ts", "text").collect()}
    if a.command == "sample":
        return e.sample(a.cluster, a.n, a.strategy).select("item_id", "ts", "text").collect()
    if a.command == "events":
        rows = e.events(a.after, a.limit)
        rows = rows if a.items else rows.where("type <> 'item.assigned'")
        return [r.asDict() for r in rows.collect()] if a.json else [{"seq": r.seq, "event": describe(Event.of(r))} for r in rows.collect()]
    if a.command == "serve":
        http = server(Service(e, a.api_key), a.host, a.port)
        print(f"listening on http://{a.host}:{a.port}")
        http.serve_forever()
    if a.command == "report":
        from driftclust.sinks.report import build_report

        with open(a.out, "w", encoding="utf-8") as f:
            f.write(build_report(e))
        return {"report": a.out}
    if a.command == "move":
        return e.move_item(a.item, a.cluster)
    if a.command == "merge":
        return {"survivor": e.merge_clusters(a.a, a.b, a.survivor)}
    if a.command == "split":
        return {"cluster": e.split_cluster(a.cluster, a.items)}
    if a.command in ("close", "reopen", "unlock"):
        getattr(e, f"{a.command}_cluster")(a.cluster)
        return e.get_cluster(a.cluster)
    return getattr(e, a.command)()


def _evaluate(a: argparse.Namespace, config: Config, spark) -> Any:
    from driftclust.evaluation import runner

    if a.command == "bench":
        return runner.measure(spark, a.clusters, batch=a.items, buffer=a.items)
    if a.command == "demo":
        from driftclust.sources.synthetic import stream

        result = runner.run_eval(spark, stream(spark, per_topic=a.per_topic), config.with_values(min_cluster_size=5, min_samples=3, close_after=timedelta(days=2), threshold_bounds=(0.3, 0.95), merge_threshold=0.8, discovery_min_buffer=50, sweep_interval=timedelta(hours=6), discovery_interval=timedelta(hours=6)), window=timedelta(hours=6), most=2000, speed=a.speed, store=a.store or "memory://")
        if a.report:
            from driftclust.sinks.report import build_report

            with open(a.report, "w", encoding="utf-8") as f:
                f.write(build_report(result.engine, "Demo", result.metrics))
        return result.metrics
    from driftclust.sources.files import read_items

    items = read_items(spark, a.file, config.columns)
    if a.command == "eval":
        return runner.run_eval(spark, items, config, drain=parse_duration(a.drain) if a.drain else None).metrics
    grid = {k: v for k, v in (("threshold_percentile", a.percentile), ("merge_threshold", a.merge)) if v} or None
    return [{**t.params, **t.metrics, "pareto": t.pareto} for t in runner.tune(spark, items, config, grid)]


def main(argv: list[str] | None = None, spark=None) -> int:
    a = parser().parse_args(argv)
    logging.basicConfig(level=a.log_level.upper(), format="time=%(asctime)s level=%(levelname)s logger=%(name)s msg=%(message)s")
    try:
        out = run(a, spark)
    except (KeyError, ValueError, FileNotFoundError, RuntimeError) as e:
        print(f"error: {e.args[0] if e.args else e}", file=sys.stderr)
        return 1
    if out is not None:
        _print(out, a.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())
