"""Cluster labels: titles that a language model writes from a cluster's texts and terms."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.functions.terms import labels as ctfidf_labels

log = logging.getLogger("driftclust.titles")

#: A title's longest length in characters.
LONGEST = 80


def prompt(terms: str, texts: list[str]) -> str:
    return "\n".join(["These texts belong to one topic. Answer with a title for it of at most eight words, and nothing else.", f"Telling words: {terms}", "Texts:", *(f"- {t}" for t in texts)])


def clean(answer: str) -> str:
    """The first line of an answer that says something, without quotes and a closing dot, cut to LONGEST characters with an ellipsis."""
    line = next((x.strip() for x in (answer or "").splitlines() if x.strip()), "").removeprefix("Title:").strip().strip("\"'“”*# ").rstrip(".")
    return line if len(line) <= LONGEST else line[: LONGEST - 1].rstrip() + "…"


def title_labeler(complete: Callable[[str], str], sample: int = 10, chars: int = 300, terms: int = 5) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """A labeler (texts, targets) that asks ``complete`` once for each target, with ``sample`` of its texts cut to ``chars`` characters. Where it fails
    or says nothing, the label is the telling terms. The targets of a job, which are clusters, come to the driver with their sample."""

    def label(texts: DataFrame, targets: DataFrame) -> DataFrame:
        named = {r.cluster_id: r.label for r in ctfidf_labels(texts, n=terms, targets=targets).collect()}
        ranked = texts.join(targets.select("cluster_id"), "cluster_id", "left_semi").withColumn("__rank", F.row_number().over(W.partitionBy("cluster_id").orderBy(F.desc("pos")))).where(F.col("__rank") <= sample)
        shown: dict[str, list[str]] = {}
        for r in ranked.select("cluster_id", "__rank", F.substring("text", 1, chars).alias("text")).orderBy("cluster_id", "__rank").collect():
            shown.setdefault(r.cluster_id, []).append(r.text)
        made = []
        for cluster, some in shown.items():
            try:
                title = clean(complete(prompt(named.get(cluster) or "", some)))
            except Exception:
                log.exception("no title for %s", cluster)
                title = ""
            made.append((cluster, title or named.get(cluster)))
        return texts.sparkSession.createDataFrame(made, "cluster_id string, label string")

    return label
