"""What stages of Python keep: free memory goes back to the system, and calibration writes no tables."""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from driftclust.llm import decontam, importance, jaccard
from driftclust.llm import toxicity as T

BATCH = pa.RecordBatch.from_arrays([pa.array([1, 2], pa.int64()), pa.array(["a b c d e f", "b c"]), pa.array([0, 0], pa.int32()), pa.array([1, 0], pa.int32())], ["doc_id", "text", "part", "toxic"])


@pytest.mark.parametrize("run", [jaccard._describe(2, True, 80, 100), importance._count(np.array([1])), decontam._items(20, 20), T._count])
def test_stages_give_free_memory_back(monkeypatch, run):
    given = []
    monkeypatch.setattr(pa, "default_memory_pool", lambda: SimpleNamespace(release_unused=lambda: given.append(1)))
    batch = BATCH.append_column("item_id", BATCH.column("doc_id"))
    made = sum(1 for _ in run(iter([batch])))
    assert made and len(given) == made + 1
    given.clear()
    assert next(run(iter([batch]))) is not None  # a stage that is left early, too
    assert given


def test_calibration_writes_no_table_and_names_languages_with_enough_of_either_label(spark, monkeypatch):
    cuts, cut = [], T.cut
    monkeypatch.setattr(T, "cut", lambda df, what: (cuts.append(what), cut(df, what))[1])
    langs = ["en", "de", None]
    docs = spark.createDataFrame([(i, f"{'awful' if i % 2 else 'lovely'} words {i % 7}", langs[i % 10 % 3] if i % 10 < 6 else "en") for i in range(600)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, i % 2 if i % 10 not in (1, 4) else 0) for i in range(600)], "doc_id long, quality int, toxic int")
    model = T.ToxicityModel(docs, labels, enough=5)
    assert set(cuts) == {"toxicity-rows", "toxicity-means"}
    checked = lambda i: T.mix(np.array([i]), 0)[0] % np.uint64(5) == 0 and __import__("zlib").crc32(str(i).encode()) % 5
    count = {}
    for r in docs.join(labels, "doc_id").where("doc_id is not null").collect():
        if checked(r.doc_id):
            count.setdefault(r.lang or "", [0, 0])[r.toxic] += 1
    assert set(model.thresholds) == {k for k, v in count.items() if min(v) >= 5} and len(model.thresholds) < 3
