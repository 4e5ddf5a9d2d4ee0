"""The toxicity network against brute force, and what its scores may and may not rest on."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from driftclust.llm import toxicity as T

DOCS, LABELS = "doc_id long, text string, lang string, source string", "doc_id long, quality int, toxic int"


def network(seed=3):
    rng = np.random.default_rng(seed)
    table = rng.standard_normal((T.BUCKETS + 1, 5)).astype(np.float32)
    table[-1] = 0
    n = 2 * len(T.WIDTHS)
    return T.Network(table, rng.standard_normal((5, 2 * sum(T.WIDTHS))).astype(np.float32), rng.standard_normal(n).astype(np.float32), rng.standard_normal(n).astype(np.float32), 0.2, 1.5, -0.1)


def pooled(net, text):
    """Each filter over each window, one by one."""
    raw = text.encode()
    words = "".join(chr(T._FOLDED[b]) for b in raw).split(" ")
    words = [w.encode("latin-1") for w in words if w]
    vectors = []
    for w in words:
        _, rows, _, _, _ = T.words_of(np.frombuffer(w, np.uint8), np.array([0, len(w)]))
        vectors.append(net.table[rows[0]].mean(0))
    out = np.full(len(net.biases), -np.inf if words else 0.0)
    for t in range(len(words)):
        col = 0
        for k, width in enumerate(T.WIDTHS):
            for f in range(net.n):
                said = sum(vectors[t + j] @ net.filters[:, col + j * net.n + f] for j in range(width) if t + j < len(words))
                out[k * net.n + f] = max(out[k * net.n + f], said)
            col += width * net.n
    return out


TEXTS = ["", " .,\n", "One", "ONE two", "één twee DRIE vier, vijf's", "a a a a b", "x" * 50, "Ende!"]


def test_pooling_equals_brute_force():
    net = network()
    texts = TEXTS + [" ".join(random.Random(i).choices("alpha beta gamma Delta été x1".split(), k=i)) for i in range(9)]
    got = T.pooled_texts(net, [t.encode() for t in texts])
    assert np.allclose(got, [pooled(net, t) for t in texts], atol=1e-4)
    assert np.allclose(T.pooled_texts(net, []), np.zeros((0, 6)))


@pytest.mark.parametrize("size", [7, 40, 333])
def test_long_texts_in_pieces_are_read_whole(monkeypatch, size):
    rng = random.Random(size)
    text = " ".join(rng.choice("ab cde fghi jklmnopqrstuvwxyzab ä öü".split()) + str(rng.randrange(60)) for _ in range(400)) + " ,, "
    whole = T.pooled_texts(network(), [text.encode()])
    monkeypatch.setattr(T, "SLICE_BYTES", size)
    assert np.allclose(network()._pool_long(np.frombuffer(text.encode(), np.uint8)), whole[0], atol=1e-5)


def corpus(n=500, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "ba ke lo mi nu ra te vo".split() for b in "ban kel los min nur rat tev vox".split()]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(vocabulary, k=rng.randint(3, 120))
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["vilex", "vilor", "vilun"]) if i % 3 else "grumpf")
        docs.append((i, " ".join(words), "en" if i % 3 else "de", None))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def scores(spark, docs, labels):
    return {r.doc_id: r for r in T.toxicity(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()}


def test_learns_from_labels_outside_of_the_held_out_part_only(spark):
    docs, labels = corpus()
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    got = scores(spark, docs, labels)
    assert {i for i, r in got.items() if r.held_out} == held and all(r.predicted == (r.score >= 0.5) and r.flagged == (r.score >= r.threshold) and 0 <= r.score <= 1 for r in got.values())
    right = [got[i].predicted == y for i, _, y in labels if i in held]
    assert np.mean(right) > 0.97
    turned = scores(spark, [(i, t, "xx" if i in held else lang, "s") for i, t, lang, _ in docs], [(i, q, 1 - y if i in held else y) for i, q, y in labels])
    assert all(turned[i].score == r.score for i, r in got.items())


def test_nulls_repeats_clashing_columns_and_empty_tables(spark):
    docs, labels = corpus(200)
    odd = [(None, docs[0][1], None, None), (900, None, None, None), (901, "", "en", None), (902, " \n", "en", None), (3, docs[3][1], "en", None), (903, "grumpf vilex", "fr", None), (904, "w " * 300_000 + "vilex vilor", "en", None)]
    labels += [(None, 1, 1), (5, None, None), (950, 1, 1), (7, 0, 1)]
    df = spark.createDataFrame(docs + odd, DOCS).selectExpr("*", "1 as score", "2 as threshold", "3 as toxic", "4 as t").repartition(4)
    rows = T.toxicity(df, spark.createDataFrame(labels, LABELS).selectExpr("*", "1 as text", "1 as lang")).collect()
    assert len(rows) == 207 and rows[0].__fields__ == ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"]
    of = lambda i: [r for r in rows if r.doc_id == i]
    assert of(900)[0].score == of(901)[0].score == of(902)[0].score < 0.5 and len({r.score for r in of(3)}) == 1 and len(of(3)) == 2
    assert of(903)[0].predicted == 1 and of(904)[0].predicted == 1 and of(None)[0].held_out is False
    assert T.toxicity(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    assert {r.score for r in T.toxicity(spark.createDataFrame(docs[:5], DOCS), spark.createDataFrame([], LABELS)).collect()} == {0.5}


def test_learns_from_all_rows_of_any_length_in_parts(spark, monkeypatch):
    docs, labels = corpus(9000)
    docs = [(i, t if i >= 40 or i % 4 else "ba ke " * 12_000 + "longtox " + "lo mi " * 20, lang, s) for i, t, lang, s in docs]  # over 64 KB
    monkeypatch.setattr(T, "PART_BYTES", 1 << 20)
    monkeypatch.setattr(T, "TOKENS", 4096)
    df = spark.createDataFrame(docs, DOCS)
    model = T.ToxicityModel(df, spark.createDataFrame(labels, LABELS))
    held = {i for i, *_ in docs if zlib.crc32(str(i).encode()) % 5 == 0}
    assert model.learnt + model.checked == len(docs) - len(held)
    got = {r.doc_id: r.predicted for r in model.score(df).collect()}
    assert np.mean([got[i] == y for i, _, y in labels if i in held and i >= 40]) > 0.97


def test_thresholds_are_those_of_the_language(spark):
    assert T.best_threshold(np.array([0.9, 0.8, 0.4, 0.3, 0.1]), np.array([1, 1, 1, 0, 0])) == pytest.approx(0.35)
    docs, labels = corpus(400)
    model = T.ToxicityModel(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS), enough=5)
    assert set(model.thresholds) == {"en", "de"}
    got = {r.doc_id: r.threshold for r in model.score(spark.createDataFrame(docs[:9] + [(1000, "x", "zz", None), (1001, "x", None, None)], DOCS)).collect()}
    assert got[0] == model.thresholds["de"] and got[1] == model.thresholds["en"] and got[1000] == got[1001] == model.threshold


def test_words_are_numbered_a_slice_of_texts_at_a_time(monkeypatch):
    rnd = random.Random(5)
    texts = [" ".join(f"w{rnd.randrange(90)}" for _ in range(rnd.randrange(30))) for _ in range(900)]
    texts[3], texts[500] = "", " ,; " + "long " * 900 + "end"
    part, toxic = [i // 400 for i in range(900)], [i % 2 for i in range(900)]
    batches = [pa.RecordBatch.from_pydict({"part": pa.array(part[a : a + 300], pa.int32()), "toxic": pa.array(toxic[a : a + 300], pa.int32()), "text": texts[a : a + 300]}) for a in (0, 300, 600)]
    monkeypatch.setattr(T, "SLICE_BYTES", 4096)
    monkeypatch.setattr(T, "runs", lambda offsets, limit=4096, f=T.runs: f(offsets, limit))
    calls, plain = [], T.words_of
    monkeypatch.setattr(T, "words_of", lambda *a: calls.append(1) or plain(*a))
    found = list(T._parts(iter(batches)))
    assert len(calls) < 60  # one for each text before
    assert [p for p, _ in found] == [0, 1, 2]
    for p, corpus in found:
        own = [t for t, q in zip(texts, part, strict=True) if q == p]
        words = [t.replace(",", " ").replace(";", " ").split() for t in own]
        names, rows = {}, corpus.rows()
        assert corpus.labels == [y for y, q in zip(toxic, part, strict=True) if q == p]
        for want, tok in zip(words, corpus.tokens, strict=True):
            assert len(want) == len(tok) and all(names.setdefault(w, t) == t for w, t in zip(want, tok.tolist(), strict=True))
        assert sorted(names.values()) == list(range(len(rows)))
        held = np.zeros(T.BUCKETS + 1, np.int64)
        for tok in corpus.tokens:
            held[np.unique(rows[np.unique(tok)])] += 1
        assert np.array_equal(held, corpus.held())
