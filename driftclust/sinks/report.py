"""A static HTML report of the state."""

from __future__ import annotations

import html
from typing import Any

import numpy as np
from pyspark.sql import functions as F

from driftclust.operators import sampling
from driftclust.operators.timeline import open_segments

LARGEST, SAMPLED, POINTS, COLOURS = 40, 30, 4000, ("#4269d0", "#efb118", "#ff725c", "#6cc5b0", "#3ca951", "#ff8ab7", "#a463f2", "#97bbf5")


def _short(text: str | None, n: int) -> str:
    text = text or "(no label)"
    return text if len(text) <= n else text[: n - 1].rstrip() + "…"


def _e(x: Any) -> str:
    return html.escape(str(x))


def _timeline(rows: list, names: dict[str, str]) -> str:
    if not rows:
        return "<p>No cluster was open yet.</p>"
    lo, hi = min(r.start for r in rows), max(r.end for r in rows)
    width = max((hi - lo).total_seconds(), 1)
    ids = list(dict.fromkeys(r.cluster_id for r in rows))
    bars = []
    for r in rows:
        x, w = 240 + 700 * (r.start - lo).total_seconds() / width, max(2, 700 * (r.end - r.start).total_seconds() / width)
        y = 20 * ids.index(r.cluster_id)
        bars.append(f'<rect x="{x:.1f}" y="{y + 4}" width="{w:.1f}" height="12" fill="{"#4269d0" if r.open_at_end else "#9aa5b1"}"><title>{_e(r.start)} – {_e(r.end)}</title></rect>')
    text = [f'<text x="0" y="{20 * i + 14}" font-size="12">{_e(_short(names.get(c), 38))}</text>' for i, c in enumerate(ids)]
    return f'<svg viewBox="0 0 950 {20 * len(ids)}" width="100%">{"".join(text + bars)}</svg>'


def _map(rows: list, largest: list[str], names: dict[str, str]) -> str:
    if len(rows) < 3:
        return "<p>Too few items for a map.</p>"
    x = np.array([r.embedding for r in rows], float)
    x -= x.mean(axis=0)
    _, axes = np.linalg.eigh(x.T @ x)
    xy = x @ axes[:, ::-1][:, :2]
    span = np.ptp(xy, axis=0)
    xy = (xy - xy.min(axis=0)) / np.where(span > 0, span, 1)
    colour = {c: COLOURS[i] for i, c in enumerate(largest[: len(COLOURS)])}
    dots = [f'<circle cx="{20 + 900 * a:.1f}" cy="{20 + 460 * b:.1f}" r="3" fill="{colour.get(r.cluster_id, "#c4c9cf" if r.cluster_id else "#e8eaed")}"><title>{_e(_short(r.text, 80))}</title></circle>' for r, (a, b) in zip(rows, xy, strict=True)]
    keys = " ".join(f'<span style="color:{c}">● {_e(_short(names.get(i), 30))}</span>' for i, c in colour.items())
    return f'<svg viewBox="0 0 940 500" width="100%">{"".join(dots)}</svg><p>{keys} ● Other ● Unassigned</p>'


def build_report(engine, title: str = "Clusters", metrics: dict[str, Any] | None = None) -> str:
    """Tiles, metrics, when the largest clusters were open, a map of items, a table, and samples. What is drawn is bounded: 40 clusters in
    the timeline, 4000 items in the map, 30 clusters with samples."""
    s = engine.store.snapshot()
    stats = engine.stats()
    clusters = s.table("clusters").where("status <> 'merged'")
    top = clusters.orderBy(F.desc("size"), "id").limit(LARGEST).collect()
    names = {r.id: r.label for r in top}
    ids = engine.spark.createDataFrame([(r.id,) for r in top], "cluster_id string")
    segments = open_segments(s.table("events")).join(F.broadcast(ids), "cluster_id").orderBy("start").collect()
    items = s.items().join(s.vectors(), "id")
    drawn = items.orderBy(F.md5("id")).limit(POINTS).select("cluster_id", "text", "embedding").collect()
    members = items.withColumnRenamed("id", "item_id").join(F.broadcast(ids.limit(SAMPLED)), "cluster_id")
    samples: dict[str, list[str]] = {}
    for r in sampling.mixed(members, 6, engine.config.random_seed).orderBy("cluster_id", "rank").collect():
        samples.setdefault(r.cluster_id, []).append(r.text)
    total = sum(stats["items"].values())
    tiles = {"items": total, "assigned": f"{stats['items']['assigned'] / total:.0%}" if total else "–", **{f"{k} clusters": v for k, v in stats["clusters"].items() if k != "merged"}, "buffered": stats["items"]["buffered"], "orphaned": stats["items"]["orphaned"]}
    tile = "".join(f'<div class="tile"><b>{_e(v)}</b><span>{_e(k)}</span></div>' for k, v in tiles.items())
    scores = "".join(f"<tr><td>{_e(k.replace('_', ' '))}</td><td>{_e('–' if v is None else v)}</td></tr>" for k, v in (metrics or {}).items())
    table = "".join(f"<tr><td>{_e(r.id)}</td><td>{_e(_short(r.label, 60))}</td><td>{_e(r.status)}</td><td>{r.size}</td><td>{_e(r.first_seen)}</td><td>{_e(r.last_seen)}</td></tr>" for r in top)
    said = "".join(f"<h3>{_e(names.get(c) or c)}</h3><ul>{''.join(f'<li>{_e(t)}</li>' for t in ts)}</ul>" for c, ts in samples.items())
    return (
        f"<!doctype html><html><head><meta charset='utf-8'><title>{_e(title)}</title><style>body{{font:14px sans-serif;max-width:960px;margin:2em auto}}.tile{{display:inline-block;margin:0 1.5em 1em 0}}.tile b{{display:block;font-size:1.8em}}"
        f"table{{border-collapse:collapse;width:100%}}td,th{{border-bottom:1px solid #ddd;padding:3px 8px;text-align:left}}</style></head><body><h1>{_e(title)}</h1>{tile}"
        + (f"<h2>Quality</h2><table>{scores}</table>" if scores else "")
        + f"<h2>When clusters were open</h2>{_timeline(segments, names)}<h2>Map</h2>{_map(drawn, [r.id for r in top], names)}"
        f"<h2>Largest clusters</h2><table><tr><th>id</th><th>label</th><th>status</th><th>items</th><th>first</th><th>last</th></tr>{table}</table><h2>Samples</h2>{said}</body></html>"
    )
