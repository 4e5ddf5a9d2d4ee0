"""The prefix trie and the filter audit against brute force."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest

from driftclust.llm.filter_audit import audit_filters
from driftclust.llm.prefix_trie import prefix_trie

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_trie(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            key = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role, key, text))
    convs = {c: [(r, t) for _, r, _, t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c in convs:
        h, base = zlib.crc32(str(c).encode()) % 4, c - int(abs(c) % 20 * (1 if c > 0 else -1))
        built[c] = tuple(convs.get(base, [])[:h] + convs[c][h:])
    members = {}
    for c, s in built.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    out = []
    for node, own in members.items():
        below = [n for n in members if n[: len(node)] == node]
        kids = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[: len(n)] == n and len(m) == len(n) + 1 for m in members)]
        saved = sum((len(members[n]) - 1) * len(WORD.findall(n[-1][1])) for n in below if n)
        ends = sorted(c for c in own if len(built[c]) == len(node))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(kids), len(leaves), saved, hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("seed,partitions", [(0, 1), (1, 3), (2, 7), (3, 40), (4, 13)])
def test_trie_equals_brute_force(spark, seed, partitions):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-30, 140), 90):
        for t in range(rng.choice([1, 1, 2, 3, 4, 6, 11])):
            rows.append((c, t, rng.choice(["user", "user", "assistant"]), rng.choice(["a b", "a b", " c\x0bd\te ", "", "f"])))
    rows += [(40, None, None, "x y"), (41, 0, "user", None), (41, 0, "user", None), (60, 2, "user", "tie"), (60, 2, "user", "tie 2"), (61, 2, "b", "t"), (61, 2, "a", "t"), (None, 0, "user", "nobody"), (77, 5, "us", "erx"), (77, 5, "user", "x")]
    long = [(500 + k, t, "user", f"turn {t}") for k in range(3) for t in range(300 - 50 * k)] + [(503, t, "user", "turn 0" if t < 200 else "other") for t in range(260)]
    rows += long if seed == 3 else []
    rng.shuffle(rows)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, CONV)).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted(got, key=str) == brute_trie(rows)


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], CONV)).collect() == []
    lone = [c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3][:2]  # borrow three turns of conversation 20, which is absent
    rows = [(c, t, "user", "hi") for c in lone for t in range(2)]
    got = [tuple(r) for r in prefix_trie(spark.createDataFrame(rows, CONV)).collect()]
    assert got == [(lone[0], 0, None, 2, 0, 1, 0, hashlib.sha256(f"{lone[0]},{lone[1]}".encode()).hexdigest())]


def test_trie_with_other_columns_and_many_equal_conversations(spark):
    rows = [(20 * c, t, "user", "same text") for c in range(6000) for t in range(2)]
    df = spark.createDataFrame(rows, CONV).selectExpr("*", "1 as path", "2 as base", "3 as ids", "4 as key")
    got = sorted(prefix_trie(df).collect())
    assert [(r.depth, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens) for r in got] == [(0, 6000, 1, 1, 4 * 5999), (1, 6000, 1, 1, 4 * 5999), (2, 6000, 0, 1, 2 * 5999)]
    assert got[2].ends_sha256 == hashlib.sha256(",".join(str(20 * c) for c in range(6000)).encode()).hexdigest()


def brute_audit(docs, labels):
    docs = [(i, t or "", lang or "") for i, t, lang in docs]
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    fails = []
    for i, t, _ in docs:
        w = WORD.findall(t)
        fails.append({f for f, bad in [("A", len(w) < 200), ("B", 100 * len(set(w)) < 50 * len(w)), ("C", 100 * len(re.findall("[A-Z]", t)) > 3 * len(t)), ("D", bool(re.search("[#$%&*|]", t))), ("E", i is not None and any(j is not None and j < i and u == t for j, u, _ in docs))] if bad})
    out, shapley = [], {}
    for part in {p for _, _, p in docs}:
        rows = [(i, f) for (i, _, p), f in zip(docs, fails) if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = rows
            for k, f in enumerate(order):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                out.append([part, order, k + 1, len(left), len(gone), sum(f in r[1] and bool(r[1] & set(order[:k])) for r in rows), sum(r[1] == {f} for r in rows), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)])
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return sorted(tuple(r + [shapley[r[0], r[1][r[2] - 1]]]) for r in out)


DOCS, LABELS = "doc_id long, text string, lang string", "doc_id long, quality int, toxic int"


@pytest.mark.parametrize("frequent", [3, 1000])
def test_audit_equals_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr("driftclust.llm.filter_audit.FREQUENT", frequent)
    monkeypatch.setattr("driftclust.llm.filter_audit.SLICE_ROWS", 40)
    rng = random.Random(5)
    words = ["Über", "maß", "x", "Yes", "a&b", "50%", "na na", "z"] + [f"w{i}" for i in range(300)]
    docs = []
    for i in range(150):
        kinds = rng.choice([words, words[:5], words[8:], words[8:]])
        docs.append((i, rng.choice([" ", "\n", " \x0b"]).join(rng.choices(kinds, k=rng.choice([0, 3, 150, 199, 200, 201, 400]))), rng.choice(["en", "de", None, ""])))
    docs += [(rng.randrange(160, 300), *docs[rng.randrange(100)][1:]) for _ in range(60)]
    docs += [(500 + i, docs[11][1], "de") for i in range(90)]
    docs += [(7, docs[7][1], "fr"), (None, docs[3][1], "en"), (None, None, "en"), (400, None, None), (401, "", "en"), (402, "A" * 3 + "b" * 97, "en"), (403, "A" * 4 + "b" * 97, "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (999, 1, 1)]
    rng.shuffle(docs)
    got = audit_filters(spark.createDataFrame(docs, DOCS).selectExpr("*", "1 as part", "2 as key", "3 as mask").repartition(5), spark.createDataFrame(labels, LABELS).selectExpr("*", "1 as part", "true as good"))
    assert sorted(tuple(r) for r in got.collect()) == brute_audit(docs, labels)


def test_audit_of_nothing_and_of_a_very_long_text(spark, monkeypatch):
    assert audit_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)).count() == 0
    monkeypatch.setattr("driftclust.llm.filter_audit.SLICE_BYTES", 1000)
    from driftclust.llm.filter_audit import _words

    text = " ".join(f"é{i % 700}" for i in range(1401)) + " " + "long" * 2000 + "\t\n"
    assert _words(text.encode()) == (1402, 701)
