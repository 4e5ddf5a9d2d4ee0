"""Operators against brute-force versions over small tables with nulls, empty and long texts, ties, repeated rows and odd columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from driftclust.llm import chat, common, decontam, fertility, importance, jaccard, lines, mixing, order, queries, ring, rtree, tokens
from driftclust.llm.html_text import main_text

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the of and ring lane hollow Änderung été 你好 don't x9 river stone".split()


def rows(seed=1, n=120):
    """Prose, copies, near copies, blanks, nulls in every column, repeated rows and one long text."""
    r = random.Random(seed)
    vocabulary = WORDS + [f"w{i}" for i in range(400)]
    texts = [" ".join(r.choice(vocabulary) for _ in range(r.randint(1, 150))) for _ in range(n)]
    texts = [t.replace(" ", "\n", r.randint(0, 3)) for t in texts]
    for i in range(0, n, 4):
        words = texts[r.randrange(n)].split(" ")
        for _ in range(r.randint(0, max(1, len(words) // 40))):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts[i] = " ".join(words)
    texts[5], texts[6], texts[7], texts[8] = None, "", " \t\n", "ONE two"
    texts[9] = "one TWO"
    texts[10] = " ".join(f"v{r.randint(0, 10**6)}" for _ in range(30_000))
    texts[11] = texts[10] + " tail"
    out = [(i, t, r.choice(["en", "de", None]), r.choice(["a", "a", "a", "b", "c", None]), r.choice([None, 3])) for i, t in enumerate(texts)]
    out += [out[20], out[20], (None, "no name " * 30, None, None, None), (None, None, None, None, None)]
    return out


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


# --- hashing ------------------------------------------------------------------------------------------------------


def test_word_hashes_follow_words_not_places():
    texts = ["a b  a\tb", None, "", "xa b", "a\x0bb\x0ca", "é a"]
    got = dict(zip(range(6), [h for _, hs in common.word_hashes(pa.array(texts), True) for h in hs], strict=True))
    a, b = got[0][0], got[0][1]
    assert got[0].tolist() == [a, b, a, b] and got[1].tolist() == [] == got[2].tolist()
    assert got[3][1] == b and got[3][0] != a and got[4].tolist() == [a, b, a] and got[5][1] == a


def test_long_text_is_hashed_as_in_one_piece(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000))
    whole = next(common.word_hashes(pa.array([text]), False))[1][0]
    monkeypatch.setattr(common, "SLICE_BYTES", 512)
    pieces = next(common.word_hashes(pa.array([text]), False))[1][0]
    assert whole.tolist() == pieces.tolist() and len(whole) == 5000


# --- op3 ----------------------------------------------------------------------------------------------------------


def brute_classes(data, k, num, den):
    sets, parent = {}, {}
    for i, t, *_ in data:
        if i is None:
            continue
        w = (t or "").encode().lower().split()
        s = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
        sets.setdefault(i, []).append(s)
        parent[i] = i

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and top(a) != top(b):
                for x in sets[a]:
                    for y in sets[b]:
                        i = len(x & y)
                        if x and y and den * i >= num * (len(x) + len(y) - i):
                            p, q = sorted((top(a), top(b)))
                            parent[q] = p
    return {i: (len(sets[i][0]), top(i)) for i in ids}


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (1, 50)])
def test_jaccard_classes(spark, k, num):
    data = rows()
    got = jaccard.jaccard_components(frame(spark, data), k, num, 100).collect()
    assert len(got) == len(data)
    want = brute_classes(data, k, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None for r in got if r.doc_id is None)


def test_jaccard_of_no_rows(spark):
    assert jaccard.jaccard_components(frame(spark, rows()).where("false"), 3, 90, 100).count() == 0


def test_jaccard_shuffles_no_texts_or_points_to_pick_them(spark, monkeypatch):
    plans, cut = {}, jaccard.cut
    monkeypatch.setattr(jaccard, "cut", lambda df, what: plans.__setitem__(what, df._jdf.queryExecution().executedPlan().toString()) or cut(df, what))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables of any size
    try:
        data = rows()
        got = jaccard.jaccard_components(frame(spark, data), 3, 90, 100).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == brute_classes(data, 3, 90, 100)
    assert not any("hashpartitioning" in plans[what] for what in ("member-sets", "points"))


def test_first_of_each_keeps_columns(spark):
    data = rows()
    kept = jaccard.first_of_each(frame(spark, data), 3, 90, 100)
    classes = brute_classes(data, 3, 90, 100)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(i for i, *_ in data if i is not None and classes[i][1] == i)


@given(st.integers(1, 400), st.integers(0, 2**32), st.sampled_from([(90, 100), (80, 100), (50, 100)]), st.floats(0, 1))
@settings(max_examples=60, deadline=None)
def test_similar_sets_share_a_block(n, seed, t, part):
    r = np.random.default_rng(seed)
    base = r.integers(0, 2**63, n).astype(np.uint64)
    spare = int(n * (t[1] - t[0]) / (t[1] + t[0]) * part)
    other = np.unique(np.concatenate((base[spare:], r.integers(0, 2**63, spare).astype(np.uint64))))
    base = np.unique(base)
    both = len(np.intersect1d(base, other))
    if t[1] * both >= t[0] * (len(base) + len(other) - both):
        assert np.intersect1d(jaccard.block_hashes(base, *t), jaccard.block_hashes(other, *t)).size


@given(st.integers(1, 700), st.integers(0, 1000))
@settings(max_examples=25, deadline=None)
def test_tree_finds_what_the_bound_allows(n, seed):
    r = np.random.default_rng(seed)
    points = r.poisson(r.choice([0.5, 3]), (n, 16)).astype(np.int32)
    points[n // 2 :] = points[r.integers(0, n, n - n // 2)]
    sizes = points.sum(axis=1)
    tree = rtree.CountTree(points, sizes)
    for q in r.integers(0, n, 5):
        bound = np.minimum(points, points[q]).sum(axis=1)
        want = np.flatnonzero(bound * 190 >= 90 * (sizes + sizes[q]))
        got, bounds = tree.search(points[q], int(sizes[q]), 90, 100)
        assert sorted(got.tolist()) == want.tolist()
        assert (bounds == bound[got]).all()


def test_large_stars_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "CHUNK", 8)
    monkeypatch.setattr(jaccard, "STAR", 4)
    r = random.Random(12)
    base = [f"w{i}" for i in range(200)]
    data = []
    for i in range(90):  # near copies of one text, some of them of each other only
        words = list(base)
        for _ in range(r.randint(0, 12)):
            words[r.randrange(200)] = f"x{r.randint(0, 9)}"
        data.append((i, " ".join(words), None, None, None))
    got = {x.doc_id: x.component_id for x in jaccard.jaccard_components(frame(spark, data), 3, 90, 100).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(198)} for i, t, *_ in data}
    label = {i: i for i in sets}
    links = [(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 90 * len(sets[i] | sets[j])]
    for _ in sets:
        for i, j in links:
            label[i] = label[j] = min(label[i], label[j])
    assert len(links) > 100 and got == label


# --- op1 ----------------------------------------------------------------------------------------------------------


def text_with(*parts):
    return "\n".join(parts)


def test_line_dedup(spark):
    shared = [f"this is shared line number {i} with a few words" for i in range(4)]
    boiler = "a very short line"
    data = [
        (1, text_with("opening words of the first text here", *shared, "end of the first text now"), None, None, None),
        (2, text_with("another beginning of a second text", *shared, "its own last line is here"), None, None, None),
        (3, text_with(boiler, "three has its own content only"), None, None, None),
        (4, text_with(boiler, "four has its own content only"), None, None, None),
        (5, None, None, None, None),
        (6, "", None, None, None),
        (None, text_with(*shared), None, None, None),
        (7, text_with(shared[0], "x", shared[1], "y", shared[2]), None, None, None),
        (8, text_with(*(f" {s}\t" for s in shared)), None, None, None),
    ]
    got = {r.doc_id: r for r in lines.dedup_lines(frame(spark, data)).collect()}
    assert len(got) == len(data)
    assert got[1].n_removed == 0 and got[1].text == data[0][1]
    assert got[2].text == text_with("another beginning of a second text", "its own last line is here") and got[2].n_removed == 4
    assert got[3].n_removed == got[4].n_removed == 0
    assert got[5].text is None and got[5].n_lines == 0 and got[6].text == "" and got[6].n_lines == 1
    assert got[None].text == text_with(*shared)
    assert got[7].n_removed == 0, "single lines of ten words are no block of twenty"
    assert got[8].text == "" and got[8].n_removed == 4, "white space around lines doesn't count"


def plain_patience(a, b, a0=0, b0=0):
    """Patience diff by its definition: equal ends, then the longest rising chain of elements unique in both, or numbered ones, then the gaps."""
    if not a or not b:
        return []
    if a[0] == b[0]:
        return [(a0, b0)] + plain_patience(a[1:], b[1:], a0 + 1, b0 + 1)
    if a[-1] == b[-1]:
        return plain_patience(a[:-1], b[:-1], a0, b0) + [(a0 + len(a) - 1, b0 + len(b) - 1)]
    pairs = [(i, b.index(x)) for i, x in enumerate(a) if a.count(x) == 1 == b.count(x)]
    pairs = pairs or [(i, j) for i, x in enumerate(a) for j, y in enumerate(b) if x == y and a[:i].count(x) == b[:j].count(x)]
    if not pairs:
        return []
    length = []
    for k, (_, j) in enumerate(pairs):
        length.append(1 + max((length[m] for m in range(k) if pairs[m][1] < j), default=0))
    chain, wanted, k = [], max(length), len(pairs)
    while wanted:
        k = max(m for m in range(k) if length[m] == wanted)
        chain.append(pairs[k])
        wanted -= 1
    out, last = [], (-1, -1)
    for i, j in [*reversed(chain), (len(a), len(b))]:
        out += plain_patience(a[last[0] + 1 : i], b[last[1] + 1 : j], a0 + last[0] + 1, b0 + last[1] + 1)
        out += [(a0 + i, b0 + j)] if i < len(a) else []
        last = (i, j)
    return out


def brute_lines(data, least=20):
    """Texts without lines that lie in a run of adjacent lines, of ``least`` words or more, that any earlier document has too: all pairs, diagonal by diagonal."""
    trimmed = [[x.strip(" \t\n\x0b\x0c\r") for x in t.split("\n")] if t is not None else None for _, t, *_ in data]
    out = []
    for (i, t, *_), mine in zip(data, trimmed, strict=True):
        gone = set()
        for (j, *_), other in zip(data, trimmed, strict=True):
            if i is None or j is None or j >= i or mine is None or other is None:
                continue
            for a in range(len(other)):
                for b in range(len(mine)):
                    if other[a] == mine[b] and not (a and b and other[a - 1] == mine[b - 1]):
                        n = 0
                        while a + n < len(other) and b + n < len(mine) and other[a + n] == mine[b + n]:
                            n += 1
                        if sum(len(x.encode().split()) for x in mine[b : b + n]) >= least:
                            gone |= set(range(b, b + n))
        out.append((i, "\n".join(x for at, x in enumerate(t.split("\n")) if at not in gone) if gone else t))
    return out


def _by_id(rows):
    return sorted((i if i is not None else -1, t or "") for i, t in rows)


def check_lines(spark, data):
    got = lines.dedup_lines(frame(spark, data)).collect()
    assert _by_id((r.doc_id, r.text) for r in got) == _by_id(brute_lines(data))
    texts = {i: t for i, t, *_ in data if t is not None}
    for r in got:  # blocks are equal lines here and there, of 20 words, and cover what went
        covered = set()
        for b in r.blocks:
            here, there = texts[r.doc_id].split("\n"), texts[b.earlier].split("\n")
            same = [x.strip(" \t\n\x0b\x0c\r") for x in here[b.line : b.line + b.lines]]
            assert b.earlier < r.doc_id and same == [x.strip(" \t\n\x0b\x0c\r") for x in there[b.earlier_line : b.earlier_line + b.lines]]
            assert sum(len(x.split()) for x in same) >= 20
            covered |= set(range(b.line, b.line + b.lines))
        assert len(covered) == r.n_removed
    return {r.doc_id: r for r in got}


def test_line_dedup_against_all_pairs(spark):
    r = random.Random(4)
    pool = [" ".join(r.choice(WORDS) for _ in range(r.randint(0, 12))) for _ in range(40)]
    data = [(i, "\n".join(r.choice(pool) for _ in range(r.randint(1, 30))), None, None, None) for i in range(60)]
    data += [x for x in rows(3, 40)[4:9] if x[0] not in range(60)] + [(None, data[7][1], None, None, None), (99, None, None, None, None), (98, "", None, None, None)]
    check_lines(spark, data)
    pool = [" ".join(f"{r.choice(WORDS)}{n}" for _ in range(r.choice([0, 1, 2, 4, 6, 8, 12, 25]))) for n in range(120)]
    data = [(i, "\n".join(pool[i::30]), None, None, None) for i in range(30)]  # each line is held singly first
    for i in range(30, 110):
        at = r.randrange(110)
        mine = [x for n, y in enumerate(pool[at : at + r.randint(2, 12)]) for x in ([f"own line {i} {n}"] if r.random() < 0.2 else []) + [y]]
        if r.random() < 0.3:  # moved and repeated parts
            cut = r.randrange(len(mine))
            mine = mine[cut:] + mine[:cut] + mine[: r.randint(0, 4)]
        data.append((i, "\n".join(mine), None, None, None))
    got = check_lines(spark, data)
    assert sum(x.n_removed > 0 for x in got.values()) > 20
    assert lines.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_finds_overlaps_behind_other_holders(spark):
    eight = [f"line {n} has eight words and no more" for n in range(3)]
    four = [f"short line number {n}" for n in range(12)]
    data = [(i + 1, x, None, None, None) for i, x in enumerate(eight)] + [(5, text_with(*eight), None, None, None), (9, text_with("own words", *eight), None, None, None)]
    data += [(20, text_with(*four), None, None, None), (21, text_with("something else", *four, "its end"), None, None, None)]
    passage = [f"passage {n} " + "word " * 20 for n in "ab"]
    data += [(30, text_with(*passage), None, None, None), (31, text_with(passage[1], "between", passage[0]), None, None, None), (32, text_with(passage[0], "x", passage[0], "y", passage[0]), None, None, None)]
    got = check_lines(spark, data)
    assert got[9].text == "own words" and got[21].text == text_with("something else", "its end")
    assert got[31].text == "between" and got[32].text == text_with("x", "y")
    assert [b.earlier for b in got[9].blocks] == [5] and [b.earlier for b in got[21].blocks] == [20]


def test_rows_that_repeat_are_alike(spark):
    long = "\n".join(f"a line of some ten words, the number of which is {i}" for i in range(6))
    data = [(1, long, None, None, None), (2, long + "\nend", None, None, None), (2, long + "\nend", None, None, None), (2, "start\n" + long, None, None, None)]
    got = lines.dedup_lines(frame(spark, data)).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(1, long), (2, "end"), (2, "end"), (2, "start")]


def test_hot_runs_are_sent(spark, monkeypatch):
    monkeypatch.setattr(lines, "HOT_HOLDERS", 3)
    passage = "a passage that many documents share " * 5
    check_lines(spark, [(i, text_with(f"beginning {i}", passage, f"end {i}"), None, None, None) for i in range(30)])


def test_long_texts_are_read_in_slices(monkeypatch):
    line = "word " * 700 + "end"
    text = text_with("first", line, *(f"line {i} of many" for i in range(300)), "  " + line + "\t", "", "x" * 9000, "last", "")
    whole = next(lines.line_hashes(*common.utf8(pa.array([text]))))
    monkeypatch.setattr(lines, "SLICE_BYTES", 1024)
    monkeypatch.setattr(common, "SLICE_BYTES", 1024)
    _, hashes, words = next(lines.line_hashes(*common.utf8(pa.array([text]))))
    assert words[0].tolist() == [len(x.split()) for x in text.split("\n")] == whole[2][0].tolist()
    short = np.array([len(x.strip()) <= 1024 for x in text.split("\n")])
    assert (hashes[0][short] == whole[1][0][short]).all()
    assert hashes[0][1] == hashes[0][302] and len(set(hashes[0].tolist())) == len(set(x.strip() for x in text.split("\n")))


@given(st.lists(st.integers(0, 12), max_size=40), st.lists(st.integers(0, 12), max_size=40))
@settings(max_examples=100, deadline=None)
def test_patience_matches_rise_and_are_equal(a, b):
    pairs = lines.patience(np.array(a, np.int64), np.array(b, np.int64))
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    if a == b:
        assert len(pairs) == len(a)


@given(st.lists(st.integers(0, 9), max_size=14), st.lists(st.integers(0, 9), max_size=14))
@settings(max_examples=300, deadline=None)
def test_patience_is_its_definition(a, b):
    assert lines.patience(np.array(a, np.int64), np.array(b, np.int64)) == plain_patience(a, b)


def test_only_what_is_aligned_goes(spark, monkeypatch):
    one, two = ([f"passage {p} line {i} has seven words or eight" for i in range(n)] for p, n in (("one", 5), ("two", 4)))
    data = [(1, text_with("a", *one, "b", *two, "c"), None, None, None), (2, text_with("x", *two, "y", *one, "z"), None, None, None), (3, text_with("p", *one, "q", *one, "r"), None, None, None), (4, text_with("s", *one, "t", *two, "u"), None, None, None)]
    got = check_lines(spark, data)
    assert [got[i].text for i in (2, 3, 4)] == ["x\ny\nz", "p\nq\nr", "s\nt\nu"]
    assert [tuple(b) for b in got[4].blocks] == [(1, 1, 1, 5), (1, 7, 7, 4)]  # one alignment
    assert [tuple(b) for b in got[2].blocks] == [(1, 1, 6, 5), (1, 7, 1, 4)]  # the longer part, then the other by itself
    hashes, spans = np.arange(9, dtype=np.uint64), (np.array([0, 4]), np.array([4, 0]), np.array([8, 4]))
    assert len(lines.aligned(hashes, np.full(9, 10), *spans, 20)) == 2
    monkeypatch.setattr(lines, "patience", lambda a, b: [])
    assert lines.aligned(hashes, np.full(9, 10), *spans, 20) == []


@given(st.lists(st.text(alphabet=" \tab\n", max_size=20), max_size=6))
@settings(max_examples=100, deadline=None)
def test_lines_are_found_and_counted(texts):
    data, ends = common.utf8(pa.array(texts, pa.string()))
    got = [(h, w) for _, hs, ws in lines.line_hashes(data, ends) for h, w in zip(hs, ws, strict=True)]
    seen = {}
    for text, (h, w) in zip(texts, got, strict=True):
        want = [x.strip() for x in text.split("\n")]
        assert w.tolist() == [len(x.split()) for x in want]
        for x, y in zip(want, h.tolist(), strict=True):
            assert seen.setdefault(x, y) == y
    assert len(set(seen.values())) == len(seen)


def test_exact_ranks(spark):
    r = random.Random(4)
    values = {"a": [r.gauss(0, 1) for _ in range(301)], "b": [0.5] * 40 + [0.50001] * 41, "c": [7.0], "d": [-1.0, 2.0]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g string, v double").repartition(5)
    got = {(x.g, x.share): x.v for x in fertility.exact_ranks(df, ["g"], "v", [0.0, 0.25, 0.75, 1.0]).collect()}
    assert got == {(g, p): sorted(v)[max(0, math.ceil(p * len(v)) - 1)] for g, v in values.items() for p in (0.0, 0.25, 0.75, 1.0)}


# --- op2 ----------------------------------------------------------------------------------------------------------


def test_pfair_deviation(spark):
    for weights in ([5, 3, 2], [1], [7, 7, 7], [100, 1, 1, 13, 40]):
        w = spark.createDataFrame([(f"s{i}", x) for i, x in enumerate(weights)], "source string, weight int")
        slots = {r.source: r for r in mixing.pfair_slots(w).collect()}
        period = sum(weights)
        order = {t: s for s, r in slots.items() for t in r.slots}
        assert sorted(order) == list(range(period))
        have = Counter()
        for t in range(period):
            have[order[t]] += 1
            assert all(abs(have[f"s{i}"] - x * (t + 1) / period) < 1 for i, x in enumerate(weights))


def plain_pfair(weights):
    """Earliest deadline first, slot by slot."""
    period, k, out = sum(weights), [0] * len(weights), []
    for t in range(period):
        due = [(-(-(k[i] + 1) * period // w), w, i) for i, w in enumerate(weights) if k[i] * period // w <= t]
        out.append(min(due)[2])
        k[out[-1]] += 1
    return out


def test_pfair_schedule_is_earliest_deadline_first(spark):
    r = random.Random(9)
    for weights in ([1, 1, 1, 1], [3, 3, 1, 5, 5, 5], [r.randint(1, 9) for _ in range(60)], [97] + [1] * 40, [r.randint(1, 60) for _ in range(12)]):
        w = spark.createDataFrame([(f"s{i:03}", x) for i, x in enumerate(weights)], "source string, weight int")
        order = {t: int(x.source[1:]) for x in mixing.pfair_slots(w).collect() for t in x.slots}
        assert [order[t] for t in range(sum(weights))] == plain_pfair(weights)
    assert mixing.pfair_slots(spark.createDataFrame([], "source string, weight int")).count() == 0


def test_ten_thousand_sources_are_scheduled_in_seconds(spark):
    r = random.Random(2)
    weights = [r.randint(1, 100) for _ in range(10_000)]
    began = time.monotonic()
    got = mixing.pfair_slots(spark.createDataFrame([(f"s{i:05}", x) for i, x in enumerate(weights)], "source string, weight int")).collect()
    assert time.monotonic() - began < 60
    period, slots = sum(weights), np.full(sum(weights), -1)
    for x in got:
        slots[x.slots] = int(x.source[1:])
    assert len(got) == 10_000 and (slots >= 0).all()
    for i in range(0, 10_000, 97):  # less than a block off at any time
        have = np.cumsum(slots == i)
        assert (np.abs(have - weights[i] * np.arange(1, period + 1) / period) < 1).all()


def test_mix_places_every_row(spark):
    data = rows(2)
    got = mixing.mix_sources(frame(spark, data), block_bytes=500).collect()
    assert len(got) == len(data) and all(r.slot is not None for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append((r.block, r.block_offset, r.n_bytes))
        assert r.n_bytes == len((r.text or "").encode()) + 1
    for parts in by.values():
        at = 0
        for block, offset, size in sorted(parts):
            assert block * 500 + offset == at
            at += size
    assert len({(r.slot, r.block_offset) for r in got}) == len(got)
    ordered = mixing.mixed_order(frame(spark, data), block_bytes=500)
    assert ordered.columns == ["doc_id", "text", "lang", "source", "n_chars"] and ordered.count() == len(data)


def test_mix_with_given_weights_and_clashing_columns(spark):
    data = [(i, "x" * 9, "en", "ab"[i % 2], None) for i in range(40)]
    docs = frame(spark, data).selectExpr("*", "1 as slot", "2 as block", "3 as weight")
    w = spark.createDataFrame([("a", 3), ("b", 1)], "source string, weight int")
    got = mixing.mix_sources(docs, w, block_bytes=10).collect()
    assert [r.source for r in sorted(got, key=lambda r: r.slot)][:24].count("a") == 18
    only = mixing.mix_sources(docs, w.where("source = 'a'"), block_bytes=10).collect()
    assert len(only) == 40 and all((r.slot is None) == (r.source == "b") for r in only)
    assert mixing.mix_sources(docs.where("false")).count() == 0


# --- op5 ----------------------------------------------------------------------------------------------------------


def brute_shards(data, shards, nodes):
    place = lambda x: int(hashlib.md5(("" if x is None else str(x)).encode()).hexdigest()[:15], 16)
    points = sorted((place(f"node:{s}:{v}"), s) for v in range(nodes) for s in range(shards))
    owner = [s for _, s in points]
    arcs = defaultdict(list)
    for i, t, *_ in data:
        at = place(i if i is not None else "text:" + hashlib.md5((t or "").encode()).hexdigest())
        arc = next((k for k, (p, _) in enumerate(points) if p >= at), 0)
        text = (t or "").encode()
        arcs[arc].append((at if at <= points[-1][0] else at - 2**60, i is not None, i or 0, len(text) + 1, zlib.crc32(text)))
    load = [len(data) // shards + (s < len(data) % shards) for s in range(shards)]
    full = [[] for _ in range(shards)]
    over = []
    for arc in range(len(points)):
        keys = sorted(arcs[arc])
        s = owner[arc]
        room = max(0, load[s] - len(full[s]))
        full[s] += keys[:room]
        if keys[room:]:
            over.append((arc, keys[room:]))
    for arc, keys in over:
        for step in range(1, len(points) + 1):
            s = owner[(arc + step) % len(points)]
            take = load[s] - len(full[s])
            full[s] += keys[:take]
            keys = keys[take:]
            if not keys:
                break
    return sorted((s, slot, k[2] if k[1] else None, k[3], k[4]) for s in range(shards) for slot, k in enumerate(full[s]))


@pytest.mark.parametrize("shards,nodes", [(16, 64), (3, 1), (5, 4)])
def test_shards(spark, shards, nodes):
    data = rows(5)
    docs = frame(spark, data).selectExpr("*", "'x' as shard", "7 as law")
    got = ring.shard_documents(docs, shards, nodes).collect()
    key = lambda x: (x[0], x[1], -1 if x[2] is None else x[2], *x[3:])
    want = brute_shards(data, shards, nodes)
    assert sorted(((r.shard, r.slot, r.doc_id, r.size, r.text_crc32) for r in got), key=key) == sorted(want, key=key)
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts[s] for s in range(shards)) <= 1
    assert {r.law for r in got} == {"rows"} and all(r.grown_shard is None for r in got)


def test_columns_may_have_any_name(spark):
    odd = ["__at", "__cell", "__group", "__sector", "__arc", "__one", "__rest", "__tie", "__slots", "none", "c0", "a.b", "x`y", "__dropped", "__key", "__log_weight", "__start", "__weight"]
    docs = frame(spark, rows()[:40]).select("*", *(F.lit(i).alias(c) for i, c in enumerate(odd)))
    labels = spark.createDataFrame([(i, int(i % 2), 0) for i in range(30)], "doc_id long, quality int, toxic int")
    for got in (mixing.mix_sources(docs), mixing.mixed_order(docs), ring.shard_documents(docs), importance.Resampler(docs, labels).keep(docs), jaccard.first_of_each(docs)):
        assert got.columns[: len(docs.columns)] == docs.columns
        back = got.select(*(F.col(f"`{c.replace('`', '``')}`") for c in odd)).distinct().collect()
        assert [tuple(r) for r in back] == [tuple(range(len(odd)))]


def test_rows_without_ids_are_dealt_by_text(spark):
    docs = frame(spark, [(None, f"text {i % 200}", None, "a", None) for i in range(400)])
    rows_ = ring.shard_documents(docs, 4, 8).collect()
    assert sorted(Counter(r.shard for r in rows_).values()) == [100] * 4
    assert docs.select(order.row_point(F.col("doc_id"), F.col("text"))).distinct().count() == 200


def test_shards_of_few_rows(spark):
    assert ring.shard_documents(frame(spark, rows()).where("false")).count() == 0
    assert [r.slot for r in ring.shard_documents(frame(spark, rows()[:1])).collect()] == [0]


# --- op6 ----------------------------------------------------------------------------------------------------------


def test_importance_held_out(spark):
    r = random.Random(8)
    good, bad = [f"g{i}" for i in range(200)], [f"junk{i}" for i in range(60)]
    made = [(i, " ".join(r.choice(good) if i % 4 or r.random() < 0.6 else r.choice(bad) for _ in range(r.randint(30, 200))), None, None, None) for i in range(800)]
    labels = spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(400)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.kept for x in importance.importance_resample(frame(spark, made), labels).collect()}
    held = range(400, 800)
    assert sum(got[i] for i in held if i % 4) >= 0.98 * 300
    assert sum(got[i] for i in held if i % 4 == 0) <= 5


def test_importance_edge_cases(spark):
    data = rows(6)
    docs = frame(spark, data)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert all(r.kept for r in importance.importance_resample(docs, none).collect())
    odd = spark.createDataFrame([(1, None, None), (None, 1, 0), (2, 1, 0), (2, 1, 1), (3, 1, None), (4, 0, 0), (77777, 1, 0)], "doc_id long, quality int, toxic int")
    got = importance.importance_resample(docs, odd).collect()
    assert len(got) == len(data)
    assert {r.log_weight for r in got if r.doc_id in (5, 6, 7)} == {0.0}
    assert importance.importance_resample(docs.where("false"), odd).count() == 0
    r = importance.Resampler(docs, odd, 100)
    assert r.keep(docs).columns == docs.columns
    kept = sum(x.kept for x in importance.importance_resample(docs, odd, 100).collect())
    assert r.keep(docs).count() == kept


def grams_of(text):
    words = [w for w in re.split("[\\x20\\x09-\\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if w]
    return [(0, w.encode()) for w in words] + [(1, a.encode(), b.encode()) for a, b in zip(words, words[1:], strict=False)] + [(2, w.encode()[:5]) for w in words]


def bucket_of(gram):
    one = lambda x: common.span_hashes(np.frombuffer(x, np.uint8), np.array([0]), np.array([len(x)]))
    with np.errstate(over="ignore"):
        h = [common.mix(one(gram[1]), 43), common.mix(one(gram[1]) * np.uint64(3) + one(gram[-1]), 41), common.mix(one(gram[1]), 47)][gram[0]]
    return int(h[0] & np.uint64(importance.BUCKETS - 1)) + gram[0] * importance.BUCKETS


def brute_scores(data, fit, margin, doubt):
    """Log ratios by dictionaries of n-grams, a target text against the target without it."""
    memo = {}
    texts = [[memo.setdefault(g, None) or memo.__setitem__(g, bucket_of(g)) or memo[g] for g in grams_of(t or "")] for _, t in data]
    raw = Counter(b for x in texts for b in x)
    target = Counter(b for (i, _), x in zip(data, texts, strict=True) if i in fit for b in x)
    kind = lambda c, k: sum(n for b, n in c.items() if b // importance.BUCKETS == k)
    all_raw, all_target = [kind(raw, k) for k in range(3)], [kind(target, k) for k in range(3)]
    out = []
    for (i, _), x in zip(data, texts, strict=True):
        mine, total = Counter(x), 0.0
        for b, n in mine.items():
            k = b // importance.BUCKETS
            without = n if i in fit else 0
            t, ts = target[b] - without, all_target[k] - (kind(mine, k) if i in fit else 0)
            ratio = np.log((t + 1) / (ts + importance.BUCKETS)) - np.log((raw[b] + 1) / (all_raw[k] + importance.BUCKETS))
            expected = raw[b] / all_raw[k] * ts
            total += n * ratio if abs(ratio) >= margin and abs(t - expected) >= doubt * np.sqrt(expected + 1) else 0.0
        out.append(round(total, 6))
    return out


def test_weights_against_brute_force(spark):
    r = random.Random(9)
    words = WORDS + [f"w{i}" for i in range(60)]
    data = [(i, " ".join(r.choice(words[: 20 if i % 3 else None]) for _ in range(r.randint(0, 90)))) for i in range(50)] + [(90, None), (91, ""), (92, "One  two\tÄ\n ONE")]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = {x.doc_id: x.log_weight for x in importance.importance_resample(frame(spark, [(i, t, None, None, None) for i, t in data]), labels, margin=0.2, doubt=1.0).collect()}
    want = dict(zip((i for i, _ in data), brute_scores(data, {i for i in range(40) if i % 3}, 0.2, 1.0), strict=True))
    assert got == pytest.approx(want, abs=2e-6) and len(set(want.values())) > 40


def test_weights_of_long_texts_are_those_of_one_piece():
    r = random.Random(10)
    words = [f"word{i}" for i in range(500)] + ["x" * 5000, "é" * 3000]
    long = [r.choice(words) for _ in range(120_000)]
    long[1000:1001] = ["y" * 3_000_000]  # a word longer than a slice
    texts = [" ".join(long), "short one", "\n".join(long[:50])]
    counts = np.arange(importance.KINDS * importance.BUCKETS)
    held = np.zeros((3, len(counts)), np.int64)  # what each text has of each bucket
    for i, t in enumerate(texts):
        np.add.at(held[i], list(map({g: bucket_of(g) for g in set(grams_of(t))}.__getitem__, grams_of(t))), 1)
    for fit in ([], [7, 9]):
        target = counts % 97 * 1000 + (held[0] + held[2] if fit else 0)  # the target's counts hold its texts
        models = importance.Models(counts % 89 * 2000 + held.sum(axis=0), target, np.array(fit, np.int64), 0.0, 0.0)
        got, length = models.scores(pa.array(texts), np.array([7, 8, 9]))
        for i, t in enumerate(texts):
            of = Counter(map({g: bucket_of(g) for g in set(grams_of(t))}.__getitem__, grams_of(t)))
            b, n = np.array(list(of)), np.array(list(of.values()))
            own = n if fit and i != 1 else 0 * n
            assert np.isfinite(got[i]) and (models.target[b] >= own).all()
            sums = models.sums[1] - np.bincount(b // importance.BUCKETS, weights=own, minlength=3)
            assert got[i] == pytest.approx((models.log_ratio(b, models.target[b] - own, sums[b // importance.BUCKETS]) * n).sum(), rel=1e-9, abs=1e-6)
            assert length[i] == int(np.log2(len(t.split()) + 1))


def test_kth_largest(spark):
    r = random.Random(3)
    values = {0: [r.gauss(0, 1) for _ in range(500)], 1: [float(r.randint(0, 3)) for _ in range(300)], 2: [5.0], 3: [r.random() ** 9 for _ in range(900)]}
    df = spark.createDataFrame([(g, v) for g, vs in values.items() for v in vs], "g_ int, v double").repartition(3)
    for part in (0.01, 0.4, 1.0):
        ks = {g: max(1, int(len(v) * part)) for g, v in values.items()} | {8: 3}
        assert importance.kth_largest(df, "g_", "v", ks, few=20) == {g: sorted(v, reverse=True)[ks[g] - 1] for g, v in values.items()}
    assert importance.kth_largest(df, "g_", "v", {0: 0}) == {}


def test_strata_cover_all_lengths():
    s = importance.strata(np.array([3] * 30 + [4] * 30 + [9] * 5), np.array([3] * 25 + [5] * 25 + [9] * 3), 20)
    assert s[:4].tolist() == [0, 0, 0, 0] and (s[4:] == 1).all()
    assert (importance.strata(np.array([2]), np.array([5]), 20) == 0).all()


# --- op7 ----------------------------------------------------------------------------------------------------------


def edit_distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (p != t)))
        row = new
    best = min(row)
    return best, row.index(best)


@given(st.text(alphabet="abc", min_size=1, max_size=80), st.text(alphabet="abc", max_size=120))
@settings(max_examples=200, deadline=None)
def test_bit_parallel_distance(pattern, text):
    assert decontam.best_match(pattern, text)[0] == edit_distance_in(pattern, text)[0]


def test_contaminations_against_brute_force(spark):
    r = random.Random(12)
    letters = "abcdefghij "
    items = [(i, "".join(r.choice(letters) for _ in range(r.randint(5, 90)))) for i in range(12)] + [(50, None), (51, ""), (52, "  "), (3, "second text of three is here")]
    docs = []
    for i in range(80):
        t = "".join(r.choice(letters) for _ in range(r.randint(0, 300)))
        if i % 2:
            item = list(r.choice(items[:12])[1])
            for _ in range(r.randint(0, 6)):
                at = r.randrange(len(item))
                item[at : at + r.randint(0, 1)] = r.choice([[], [r.choice(letters)], [r.choice(letters.upper())]])
                if not item:
                    item = ["a"]
            t = t[: len(t) // 2] + "".join(item).upper() + t[len(t) // 2 :]
        docs.append((i, t, None, None, None))
    docs += [(None, items[0][1], None, None, None), (90, None, None, None, None), docs[1]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, distance int")
    got = Counter((x.doc_id, x.item_id, x.distance, x.end) for x in decontam.contaminations(frame(spark, docs), bench, 10, short=0).collect())
    want = Counter()
    for i, t, *_ in docs:
        text = decontam.normal(t)
        for k, s in items:
            s = decontam.normal(s)
            if s and text:
                d, end = edit_distance_in(s, text)
                if d <= len(s) // 10:
                    want[i, k, d, end] += 1
    assert got == want


def test_short_items_must_be_telling(spark):
    bench = spark.createDataFrame([(1, "a"), (2, "the"), (3, "Yes or no?"), (4, "forty two"), (5, "exactly twenty chars"), (6, "xx yy zz")], "item_id long, text string")
    docs = [(1, "a river and the sea", None, None, None), (2, " The\n", None, None, None), (3, "so: yes  or no? who knows", None, None, None), (4, "forty two is forty two", None, None, None), (5, "inexactly twenty chars5", None, None, None), (6, "xx yy zzz, axx yy zz", None, None, None), (7, "Forty two", None, None, None), (8, "axx yy zz xx yy zz", None, None, None)]
    got = sorted((x.doc_id, x.item_id, x.distance, x.end) for x in decontam.contaminations(frame(spark, docs), bench).collect())
    assert got == [(2, 2, 0, 3), (3, 3, 0, 14), (5, 5, 0, 22), (7, 4, 0, 9), (8, 6, 0, 18)]


def test_contaminations_behind_a_full_filter(spark, monkeypatch):
    monkeypatch.setattr(decontam, "MOST_BITS", 1 << 13)
    monkeypatch.setattr(decontam, "BITS_PER_ENTRY", 1)
    monkeypatch.setattr(decontam, "SLICE_CHARS", 16)
    items = spark.createDataFrame([(i, f"item number {i} has its very own words {i * 37}") for i in range(9)], "item_id long, text string")
    docs = frame(spark, [(i, f"before item number {i} has its very own words {i * 37} after", None, None, None) for i in range(9)])
    assert sorted((r.doc_id, r.item_id) for r in decontam.contaminations(docs, items, 100).collect()) == [(i, i) for i in range(9)]
    assert decontam.contaminations(docs, items.where("false")).count() == 0


# --- op8 ----------------------------------------------------------------------------------------------------------

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "<", "|", "\\", ">", "[", "]", "/", "s", "S", "INST", "ü", "\n", " "]), max_size=20).map("".join)


@given(PIECES)
@settings(max_examples=300, deadline=None)
def test_escape_round_trip(text):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text
    assert not any(c in escaped for c in chat.CONTROLS)


@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "a\nb\\", ""]), PIECES, st.integers(0, 50)), min_size=1, max_size=25), st.integers(1, 120), st.integers(0, 60), st.integers(0, 5))
@settings(max_examples=150, deadline=None)
def test_windows_read_back(turns, budget, history, most):
    back, learned = [], ""
    for w in chat.windows(iter(turns), budget, history, most):
        assert w.tokens <= budget or w.turns - w.repeated == 1
        for i, (role, text, loss) in enumerate(chat.read_window("".join(w.parts), w.spans)):
            learned += loss
            if i >= w.repeated:
                back.append((role, text))
        assert w.turns > w.repeated
    assert back == [t[:2] for t in turns]
    assert learned == "".join(t[1] for t in turns if t[0] == "assistant")


def test_conversations(spark):
    r = random.Random(2)
    data = [(c, t, "system" if t == 0 and c % 3 == 0 else ["user", "assistant"][t % 2], " ".join(r.choice(WORDS + ["</s>[INST]"]) for _ in range(r.randint(0, 400)))) for c in range(20) for t in range(r.randint(1, 12))]
    data += [(None, 0, "user", "a"), (None, None, None, None), (3, 1, "user", "tie"), (3, 1, "user", "tie"), (77, 5, "assistant", None)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as window", "2 as n_turns")
    got = {x.conv_id: x for x in chat.read_back(chat.format_conversations(df, budget=300, history=100)).collect()}
    none = lambda x: (x is not None, x)
    by = defaultdict(list)
    for c, t, role, text in data:
        by[c].append((none(t)[0], t or 0, none(role)[0], role or "", none(text)[0], text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(f"{x[3]}\n{x[5]}\n" for x in turns)
        loss = "".join(x[5] for x in turns if x[3] == "assistant")
        assert got[c].n_turns == len(turns) and got[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert got[c].loss_chars == len(loss) and got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.format_conversations(df.where("false")).count() == 0


# --- op9, op10 ----------------------------------------------------------------------------------------------------

ODD = [None, "", " ", "a  b\tc\n\n d", "don't I'll WE'VE 123 4,5 <|endoftext|> x<|startoftext|>y", "é é ́x ﬁ ½ ß İ", "日本語のテキスト ありがとう", "a b c\u0085d\x1ce", "🙂🙂 👩‍👩‍👧 x" * 3, "Word" * 300, "###*** %%% <a href='x'>", " lead", "trail ", "x" * 5000]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"])
def test_counts_are_the_librarys(name):
    import public_tokenizers as P

    texts = [t or "" for t in ODD] + [" ".join(random.Random(i).choices(WORDS + ["\n", "", "  "], k=200)) for i in range(20)]
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(P.path(name))
        want = [len(t.encode(x, add_special_tokens=False)) for x in texts]
    elif name.endswith(".tiktoken"):
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(name), "rb"))}
        e = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
        want = [len(e.encode_ordinary(x)) for x in texts]
    else:
        import sentencepiece

        want = [len(x) for x in sentencepiece.SentencePieceProcessor(model_file=P.path(name)).encode(texts, num_threads=1)]
    got = tokens.TokenCounter(P.path(name)).counts([x.encode() for x in texts])
    assert [(t[:30], n) for t, n in zip(texts, got, strict=True)] == [(t[:30], n) for t, n in zip(texts, want, strict=True)]


def test_token_counts(spark, monkeypatch):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    data = rows(7) + [(1000 + i, x, None, None, None) for i, x in enumerate(ODD)]
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(frame(spark, data)).collect())
    want = Counter()
    for i, x, *_ in data:
        n = len(t.encode(x or "", add_special_tokens=False))
        want[i, len((x or "").encode()), n, n > 2048] += 1
    assert got == want


def test_chunks_are_the_text():
    raw = " ".join(f"word{i}" for i in range(1000)).encode()
    parts = list(tokens.text_chunks(raw, 100))
    assert b"".join(parts) == raw and max(map(len, parts)) < 120
    assert list(tokens.text_chunks(b"x" * 500, 100)) == [b"x" * 500]


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    kept = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base = (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(kept) - len(set(kept)), len(covered))
    return (*base, len(words) < 20 or 100 * len(covered) > 30 * len(words))


def test_fertility(spark):
    repeat = " ".join(["one two three four five six seven eight nine"] * 8)
    data = rows(9) + [(500, repeat, "en", None, None), (501, repeat + " " + " ".join(map(str, range(400))), "en", None, None), (502, "a\n a\na\n\n \n| # <", None, None, None)] + [(600 + i, x, "en", None, None) for i, x in enumerate(ODD)]
    got = fertility.fertility_verdicts(frame(spark, data), support=20).collect()
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got), key=key) == sorted(((i, *brute_base(t)) for i, t, *_ in data), key=key)
    assert not any(r.kept and r.base_failed for r in got)
    assert fertility.fertility_verdicts(frame(spark, data).where("false")).count() == 0


def test_fertility_measures_and_bands(spark):
    import public_tokenizers as P
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    r = random.Random(5)
    data = [(i, " ".join(r.choice(WORDS[:9] + [f"river{j}" for j in range(30)]) for _ in range(100)), "en", None, None) for i in range(150)]
    data += [(900, " ".join("ᛖᚴ" + str(j) for j in range(26)), "en", None, None), (901, " ".join(["aaa", "bbb", "ccc"][r.randrange(3)] for _ in range(130)), "en", None, None)]
    got = {x.doc_id: x for x in fertility.fertility_verdicts(frame(spark, data), support=20).collect()}
    for i, t, *_ in data[::30]:
        ids = [k for w in t.split() for k in m.encode(w)]
        share = np.array(list(Counter(ids).values())) / len(ids)
        assert got[i].n_tokens == len(ids) and got[i].byte_share == pytest.approx(sum(map(m.is_byte, ids)) / len(ids))
        assert got[i].token_entropy == pytest.approx(-(share * np.log2(share)).sum())
    assert all(got[i].kept for i in range(150)) and not got[900].kept


def brute_kept(got, langs, support, below, below_entropy, above):
    """Verdicts from the measures: for each language and length class the quartiles of its pool, sorted out one text at a time."""
    length = {r: math.log2(max(r.n_tokens, 1)) for r in got}
    cell = {r: (langs[r.doc_id], math.floor(length[r])) for r in got}
    fit = [r for r in got if not r.base_failed]
    rank = lambda xs, p: sorted(xs)[max(0, math.ceil(p * len(xs)) - 1)]
    out = {}
    for lang, size in {cell[r] for r in fit}:
        own = [r for r in fit if cell[r][0] == lang]
        pool = own if len(own) >= support else fit
        radius = next((d for d in range(64) if sum(abs(cell[r][1] - size) <= d for r in pool) >= support), 63)
        near = [r for r in pool if abs(cell[r][1] - size) <= radius]
        x, y = np.array([length[r] for r in near]), np.array([r.token_entropy for r in near])
        spread = ((x - x.mean()) ** 2).sum()
        slope = 0.0 if not radius or spread < 1e-12 else min(1.0, max(0.0, ((x - x.mean()) * (y - y.mean())).sum() / spread))
        level = {r: r.token_entropy + round(slope, 6) * (round(x.mean(), 6) - length[r]) for r in got}
        bands = []
        for measure, low, high, least in ((lambda r: r.chars_per_token, below, above, 0), (lambda r: r.byte_share, None, above, 0.02), (level.__getitem__, below_entropy, above, 0)):
            q1, q3 = (rank([measure(r) for r in near], p) for p in (0.25, 0.75))
            wide = max(q3 - q1, abs(q3) * 0.02)
            bands.append((measure, -math.inf if low is None else q1 - low * wide, q3 + max(high * wide, least)))
        for r in got:
            if cell[r] == (lang, size):
                out[r.doc_id] = not r.base_failed and bool(r.n_tokens) and all(lo - 1e-9 <= m(r) <= hi + 1e-9 for m, lo, hi in bands)
    return {r.doc_id: out.get(r.doc_id, False) and not r.base_failed for r in got}


def test_fertility_verdicts_against_brute_force(spark):
    r = random.Random(13)
    word = lambda: r.choice(WORDS[:9] + [f"river{j}" for j in range(60)])
    odd = lambda: r.choice(["ᛖᚴ7", "0x9f3a", "###", "aaaaaaaaaaaaaaaaaaaaaaaa", "我们在这里"])
    data = []
    for i in range(400):
        lang = r.choice(["en"] * 6 + ["de", "de", "sw", None])
        share = r.choice([0, 0, 0, 0.02, 0.1, 0.5, 1])
        data.append((i, " ".join(odd() if r.random() < share else word() for _ in range(int(2 ** r.uniform(3.5, 9)))), lang, None, None))
    langs = {i: lang for i, _, lang, *_ in data}
    for support in (20, 60):
        for fences in ((4.0, 3.0, 8.0), (1.0, 0.5, 1.5)):
            got = fertility.fertility_verdicts(frame(spark, data), fences=fences, support=support).collect()
            want = brute_kept(got, langs, support, *fences)
            assert {x.doc_id: x.kept for x in got} == want
            assert 20 < sum(want.values()) < len(data) - 20


def test_fertility_judges_thin_groups(spark):
    r = random.Random(6)
    prose = lambda n: " ".join(r.choice(WORDS[:9] + [f"river{j}" for j in range(30)]) for _ in range(n))
    runes = lambda n: " ".join("ᛖᚴ" + str(j) for j in range(n))
    data = [(i, prose(r.randint(40, 120)), "en", None, None) for i in range(400)]
    data += [(1000 + i, prose(n), lang, None, None) for i, (n, lang) in enumerate([(22, "en"), (6000, "en"), (25, None), (100, None), (80, "sw"), (3000, "sw")])]
    data += [(2000 + i, runes(n), lang, None, None) for i, (n, lang) in enumerate([(3000, "en"), (100, None), (90, "sw"), (2500, "sw")])]
    data += [(2010, " ".join(f"ᛖ{j}" for j in range(20, 40)), "en", None, None)]
    got = {x.doc_id: x for x in fertility.fertility_verdicts(frame(spark, data)).collect()}
    assert len(got) == len(data) and not any(x.base_failed for x in got.values())
    assert all(got[i].kept for i in got if i < 2000)
    assert not any(got[i].kept for i in got if i >= 2000)


# --- op4 ----------------------------------------------------------------------------------------------------------

BODY = "<h1>Title &amp; more</h1><p>First paragraph, with some   words &ndash; and\nmore of them, here.</p><p>Second <b>para</b>graph<br>continues, quite long enough to count as text.</p>"
TEXT = "Title & more First paragraph, with some words – and more of them, here. Second paragraph continues, quite long enough to count as text."


@pytest.mark.parametrize(
    "page",
    [
        f"<html><body><nav><a href=/>Home</a></nav><article>{BODY}</article><footer>&copy; me</footer></body></html>",
        f"<body><header><h2>Site name</h2></header><div class='ad'>Buy now, cheap, cheap, cheap, buy this today!</div><article>{BODY}</article><aside>More, more, more</aside>",
        f"<div id=sidebar><p>Lots of text, in a sidebar, that is long, long, long, and has commas, many.</p></div><div class=content>{BODY}</div><div class='comments'><p>I think, as a reader, that this is great, really.</p></div>",
        f"<main><article>{BODY}<form><p>Subscribe, now, please, to this letter</p><input><button>Go</button></form><script>if (a</b) x='<p>no</p>';</script><style>p{{}}</style></article></main>",
        f"<article>{BODY.replace('</p>', '')}<section class=comments><p>reader says, well, no</p></section></article>",
        f"<body><div class=cookie-notice>We use cookies, you know.</div><div><div class=post>{BODY}</div></div><ul class=menu><li>One</li></ul></body>",
        f"<!doctype html><!-- <p>no</p> --><ARTICLE CLASS='x'>{BODY}</ARTICLE><noscript>no</noscript><div hidden>no, no</div>",
    ],
)
def test_main_text(page):
    assert main_text(page) == TEXT


MORE = "<p>Third paragraph, which is written to be long enough, with commas, so that it counts, as text does, for the article.</p>"
FULL = TEXT + " Third paragraph, which is written to be long enough, with commas, so that it counts, as text does, for the article."
HOLDERS = {
    "article": "{before}<article>{body}{inside}</article>{after}",
    "main": "{before}<main>{body}{inside}</main>{after}",
    "main and article": "<main>{before}<article>{body}{inside}</article>{after}</main>",
    "named div": "{before}<div class='post-body'>{body}{inside}</div>{after}",
    "classless div": "{before}<div>{body}{inside}</div>{after}",
    "div in divs": "<div><div>{before}</div><div><div>{body}{inside}</div></div><div>{after}</div></div>",
    "id": "<div id=page>{before}<div id=main-content>{body}{inside}</div>{after}</div>",
    "sections": "{before}<article><section>{body}</section><section>{inside}</section></article>{after}",
    "table": "<table><tr><td>{before}</td><td>{body}{inside}</td><td>{after}</td></tr></table>",
    "one form": "<form id=aspnetForm>{before}<div class=content>{body}{inside}</div>{after}</form>",
    "wrapper with a role's name": "<div id='content-sidebar-wrap'>{before}<div class='entry-content'>{body}{inside}</div>{after}</div>",
    "unclosed": "{before}<article>{body}{inside}</article>{after}<p>",
}
JUNK = {
    "nav": "<nav><ul><li><a href=/>Home, sweet home</a></li><li><a href=/x>Elsewhere</a></li></ul></nav>",
    "ad": "<div class='ad'>Buy now, cheap, cheap, cheap, buy this today!</div>",
    "advert": "<section id=adSlot2><p>Buy now, cheap, cheap, cheap, buy this today, it is good!</p></section>",
    "sponsored": "<div class='sponsored-content'><p>Our sponsor, whom we like, has words, and commas, for you.</p></div>",
    "sidebar": "<div class='left-sidebar'><p>Lots of text, in a sidebar, that is long, long, long, and has commas.</p></div>",
    "aside": "<aside><p>Lots of text, in an aside, that is long, long, long, and has commas.</p></aside>",
    "cookies": "<div id='cookie-banner' role='alert'><p>We use cookies, and you, dear reader, must agree, or not.</p></div>",
    "notice": "<div class='site-notice'><p>Our offices are closed, on Monday, due to the weather, sorry.</p></div>",
    "comments": "<div id=comments><h3>3 comments</h3>" + "<div class=comment><p>I think, as a reader, that this, all in all, is great, really, and I say so at length.</p></div>" * 3 + "</div>",
    "comment articles": "<section class='comment-list'>" + "<article class=comment><p>I think, as a reader, that this, all in all, is great, really.</p></article>" * 2 + "</section>",
    "menu": "<ul class='menu main-menu'><li>One item, of a menu</li><li>Two</li></ul>",
    "footer": "<footer><p>All rights, as always, are reserved, by us, for ever.</p></footer>",
    "footer div": "<div class='page-footer'><p>All rights, as always, are reserved, by us, for ever.</p></div>",
    "form": "<form><p>Subscribe, now, please, to this letter, it is free.</p><input><button>Go</button></form>",
    "newsletter": "<div class='newsletter-signup'><p>Subscribe, now, please, to this letter, it is free.</p></div>",
    "related": "<div class='related-posts'><ul><li><a href=/1>Another post, about things</a></li><li><a href=/2>And one more</a></li></ul></div>",
    "role": "<div role=complementary><p>Lots of text, in a box, that is long, long, long, and has commas.</p></div>",
    "hidden": "<div style='display: none'><p>Text that nobody, but nobody, is meant, ever, to see here.</p></div>",
    "script": "<script>if (a</b) x = '<p>no, no, no</p>';</script><style>p{margin:0}</style><noscript><p>no, no</p></noscript>",
    "share": "<div class='social share-buttons'><a href=#>Share this</a> <a href=#>Or that</a></div>",
}


@pytest.mark.parametrize("holder", HOLDERS)
def test_main_text_in_any_page(holder):
    for name, junk in JUNK.items():
        for place in ("before", "inside", "after"):
            page = "<html><body>" + HOLDERS[holder].format(**{"body": BODY + MORE, "before": "", "inside": "", "after": "", place: junk}) + "</body></html>"
            assert main_text(page) == FULL, (name, place)


@pytest.mark.parametrize(
    "page,text",
    [
        (f"<article>{BODY}<section class='related-work'>{MORE}</section></article>", FULL),
        (f"<article>{BODY}<div class='related-work'>{MORE}</div></article>", FULL),
        (f"<article>{BODY}{MORE.replace('<p>', '<p class=notice-board>')}</article>", FULL),
        (f"<div class='has-sidebar no-comments'>{BODY}{MORE}</div>", FULL),
        (f"<article><header><h1>Title</h1><p class=byline>By A. Writer</p></header>{MORE}</article>", "Title By A. Writer" + FULL.removeprefix(TEXT)),
        (f"<article><header><p class=byline>By A. Writer</p></header>{MORE}</article>", "By A. Writer" + FULL.removeprefix(TEXT)),
        (f"<article><div class='entry-header'><h1>Title</h1></div><div class='entry-content'>{MORE}</div></article>", "Title" + FULL.removeprefix(TEXT)),
        (f"<article><section>{MORE * 9}</section><section><p>Short end.</p></section></article>", " ".join([FULL.removeprefix(TEXT).strip()] * 9) + " Short end."),
        (f"<article>{MORE * 3}<article><p>An embedded note, short.</p></article><p>End.</p></article>", " ".join([FULL.removeprefix(TEXT).strip()] * 3) + " An embedded note, short. End."),
        (f"<div class='modal'>{BODY}{MORE}</div>", FULL),
        (f"<main><div class=teasers>{''.join(f'<div><a href=/{i}>Another story, {i}</a></div>' for i in range(30))}</div><div class=story>{BODY}{MORE}</div></main>", FULL),
        ("<article><p>One</p>bare text<ul><li>a</li><li>b</li></ul><table><tr><td>c</td></tr></table><pre>d\n e</pre></article>", "One bare text a b c d e"),
        (f"<article>{MORE}</article><div id=comments>" + "<div class=comment><p>I think, as a reader, that this, all in all, is great, really.</p></div>" * 30 + "</div>", FULL.removeprefix(TEXT).strip()),
    ],
)
def test_article_text_is_kept_whole(page, text):
    assert main_text(page) == text


def test_main_text_of_odd_pages():
    assert main_text(None) == main_text("") == main_text("<html><body></body></html>") == main_text("<script>x</script>") == ""
    assert main_text("just text &lt;b&gt;") == "just text <b>"
    assert main_text("<p>a<p>b<p>c") == "a b c"
    assert main_text("<article><p>x &am &a &amp") == "x &am &a &"
    deep = "<div>" * 5000 + "deep text" + "</div>" * 5000
    assert main_text(deep) == "deep text"
    long = "<article>" + "<p>" + "word, " * 200_000 + "</p></article>"
    assert len(main_text(long)) == 6 * 200_000 - 1


@given(st.text(alphabet="<>/ap=\"'!-&; divscrpt\n", max_size=200))
@settings(max_examples=200, deadline=None)
def test_any_page_has_a_text(page):
    assert main_text(page) == " ".join(main_text(page).split())


def test_extract_rows(spark):
    from driftclust.llm.html_text import extract_text

    df = spark.createDataFrame([(1, "u", f"<article>{BODY}</article>", "x"), (None, None, None, None), (1, "u", f"<article>{BODY}</article>", "x")], "page_id long, url string, html string, text string")
    got = extract_text(df).collect()
    assert sorted((r.text, r.n_chars) for r in got) == [("", 0), (TEXT, len(TEXT)), (TEXT, len(TEXT))]


# --- SQL ----------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    found = duckdb.connect().execute(f"create view documents as select * from '{DATA}/documents.parquet'").execute(queries.ORACLES[name])
    columns = [x[0] for x in found.description]
    got = queries.QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in got.collect()) == Counter(found.fetchall())
