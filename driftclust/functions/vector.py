"""Vector expressions on ``array<float>`` columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _zero() -> Column:
    return F.lit(0.0)


def dot(a: Column | str, b: Column | str) -> Column:
    """Sum of products, in element order; the cosine of unit vectors."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), _zero(), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(a, _zero(), lambda s, x: s + x.cast("double") * x.cast("double")))


def normalize(a: Column | str) -> Column:
    """The vector at length 1; a zero vector stays."""
    length = norm(a)
    return F.transform(a, lambda x: F.when(length > 0, x.cast("double") / length).otherwise(_zero()).cast("float"))


def top_k_mean(scores: Column | str, k: int) -> Column:
    """Mean of the k largest, or of all if there are fewer; null for none."""
    best = F.slice(F.sort_array(scores, asc=False), 1, k)
    return F.when(F.size(best) > 0, F.aggregate(best, _zero(), lambda s, x: s + x) / F.size(best))


def clamp(value: Column | str, low: float, high: float) -> Column:
    """Kept between low and high; a null, the percentile of nothing, is high."""
    value = F.col(value) if isinstance(value, str) else value
    return F.when(value.isNull(), F.lit(high)).otherwise(F.least(F.greatest(value, F.lit(low)), F.lit(high)))
