"""Incremental clustering of short texts on Spark."""

from __future__ import annotations

from importlib import import_module

#: What the package offers, by the module that has it; loaded when first used, so that workers load only what they run.
_PLACES = {
    "driftclust.engine": ("ClusteringEngine", "ClusterDetail", "DiscoveryReport", "Item", "ModelMismatch", "SweepReport"),
    "driftclust.config": ("Config", "load_config", "parse_duration", "format_duration"),
    "driftclust.clock": ("SimulatedClock", "SystemClock"),
    "driftclust.events": ("Event", "EventRoutes", "TerminalSink"),
    "driftclust.sinks.delivery": ("Delivery", "Hook"),
    "driftclust.functions.embed": ("HashingEmbedder", "make_embedder"),
    "driftclust.functions.titles": ("title_labeler",),
    "driftclust.scheduler": ("JobPlan", "Ticker"),
    "driftclust.state.store": ("Conflict", "StateStore"),
    "driftclust.streaming.replay": ("replay",),
    "driftclust.session": ("session",),
}
_WHERE = {name: module for module, names in _PLACES.items() for name in names if name != "session"}
__all__ = sorted(_WHERE)


def __getattr__(name: str):
    if name in _WHERE:
        return getattr(import_module(_WHERE[name]), name)
    raise AttributeError(f"module {__name__!r} has no attribute {name!r}")


def __dir__() -> list[str]:
    return [*globals(), *__all__]
