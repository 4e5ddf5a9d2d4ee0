"""Seeded streams of labelled short texts: topics that come in bursts, and one-off noise."""

from __future__ import annotations

import random
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession

START = datetime(2026, 3, 1, tzinfo=UTC)
_SYLLABLES = "ba do fe gi ku la me no pa ri su ta vo wi xe zu".split()


def vocabulary(seed: int, topic: str, n: int = 8) -> list[str]:
    """Words of a topic."""
    r = random.Random(f"{seed}:{topic}")
    return ["".join(r.choice(_SYLLABLES) for _ in range(3)) for _ in range(n)]


def _typo(r: random.Random, text: str) -> str:
    if len(text) < 4 or r.random() > 0.1:
        return text
    i = r.randrange(1, len(text) - 2)
    return text[:i] + text[i + 1] + text[i] + text[i + 2 :]


def generate(seed: int = 7, topics: int = 12, per_topic: int = 190, noise: int = 50, days: int = 8) -> list[tuple[str, str, datetime, str]]:
    """(id, text, time, label) in order of time: each topic's arrivals rise and fall about a peak of its own."""
    r = random.Random(seed)
    rows = []
    for t in range(topics):
        words, start = vocabulary(seed, f"topic{t}"), r.uniform(0, (days - 3) * 24)
        for _ in range(per_topic):
            hour = start + r.triangular(0, 48, 12)
            rows.append((_typo(r, " ".join(r.sample(words, 5))), START + timedelta(hours=hour), f"topic{t}"))
    for i in range(noise):
        rows.append((" ".join(vocabulary(seed, f"noise{i}", 5)), START + timedelta(hours=r.uniform(0, days * 24)), "noise"))
    rows.sort(key=lambda x: (x[1], x[0]))
    return [(f"it_{i:05d}", *x) for i, x in enumerate(rows, 1)]


def stream(spark: SparkSession, **how) -> DataFrame:
    """(id, text, ts, label) of ``generate``."""
    return spark.createDataFrame(generate(**how), "id string, text string, ts timestamp, label string")


def texts(n: int, seed: int = 7, topics: int = 40) -> list[str]:
    """Texts for timings: a topic's words and a random one."""
    r = random.Random(seed)
    words = [vocabulary(seed, f"topic{t}") for t in range(topics)]
    return [" ".join([*r.sample(words[r.randrange(topics)], 5), f"n{r.randrange(10**6)}"]) for _ in range(n)]
