"""Content-derived names and hash orders."""

from __future__ import annotations

from collections.abc import Iterable
from hashlib import sha256

from pyspark.sql import Column
from pyspark.sql import functions as F


def cluster_id(ids: Column) -> Column:
    """``cl_`` and 12 hex digits of the sorted member ids, one to a line."""
    return F.concat(F.lit("cl_"), F.substring(F.sha2(F.array_join(F.array_sort(ids), "\n"), 256), 1, 12))


def cluster_id_of(ids: Iterable[str], *more: str) -> str:
    """The same for ids on the driver; ``more`` tokens make another name where one is taken."""
    return "cl_" + sha256("\n".join([*sorted(ids), *more]).encode()).hexdigest()[:12]


def draw_order(seed: int | None, *parts: Column | str) -> Column:
    """A sort key that puts rows in random order, the same for the same seed and row, whatever the order in which they came."""
    if seed is None:
        return F.rand()
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts)))
