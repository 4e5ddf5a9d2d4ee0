"""Toxicity of texts by a convolutional network over hashed word embeddings, trained in numpy on all labelled rows: parts of bounded size learn side by
side from the same network, and what they make of it is averaged between rounds."""

from __future__ import annotations

import copy
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import LOWER, SLICE_BYTES, cut, drop_cut, frugal, mix, own_columns, runs, span_hashes, utf8, word_spans

#: Widths of the filters, in words.
WIDTHS = (1, 2, 3)
#: Rows of the embedding table; a word has a row for itself, its first 4 and 6 bytes and its last 4.
BUCKETS, FEATURES = 1 << 15, 4
#: Bytes of labelled texts in a part, which one task learns from at a time; tokens whose windows it holds at once.
PART_BYTES, TOKENS = 16 << 20, 1 << 17
#: Passes over the labelled texts: of a single part, and of several in each round, between which they are averaged; and these rounds.
EPOCHS, PASSES, ROUNDS = 12, 2, 3
#: Rows of the table that are averaged together; logits are counted in this many steps for each unit, up to a greatest one.
ROWS, STEPS, FAR = 1 << 10, 1 << 10, 64
#: Of five parts of the labelled rows, by crc32 of the doc_id, the one that nothing is learnt from.
PARTS, HELD_OUT = 5, 0

#: Bytes as the network reads them: A-Z in lower case, ASCII but letters and digits as white space.
_FOLDED = LOWER.copy()
_FOLDED[[b for b in range(128) if not chr(b).isalnum()]] = 32


# --- words ---------------------------------------------------------------------------------------------------------


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts in one array: the hash of each distinct word, its rows of the embedding table, each token's number among them, the tokens of
    each text, and where each token begins."""
    part = _FOLDED[data]
    starts, ends, counts = word_spans(part, offsets)
    distinct, first, tokens = np.unique(span_hashes(part, starts, ends), return_index=True, return_inverse=True)
    a, b = starts[first], ends[first]
    pieces = span_hashes(part, np.concatenate([a, a, np.maximum(a, b - 4)]), np.concatenate([np.minimum(b, a + 4), np.minimum(b, a + 6), b])).reshape(FEATURES - 1, len(a))
    rows = np.stack([mix(h, salt) % np.uint64(BUCKETS) for salt, h in enumerate([distinct, *pieces], 1)], 1).astype(np.int32)
    return distinct, rows, tokens.astype(np.int32), counts, starts


# --- the network ---------------------------------------------------------------------------------------------------


@dataclass
class Network:
    """Embeddings (a row of zeros last), filters by width and place in it side by side, their biases, weights of the output, its bias; and the line that
    makes logits of its sums."""

    table: np.ndarray
    filters: np.ndarray
    biases: np.ndarray
    weights: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    @property
    def n(self) -> int:
        return len(self.biases) // len(WIDTHS)

    def words(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of words, and of the gap after a text's end as the last."""
        return np.concatenate([self.table[rows].sum(1) / FEATURES, np.zeros((1, self.table.shape[1]), np.float32)])

    def windows(self, projected: np.ndarray, at: list[np.ndarray]) -> np.ndarray:
        """What each filter says to the window that begins at each token. ``at`` has the word at the token and at those after it."""
        out = np.empty((len(at[0]), len(self.biases)), np.float32)
        col = 0
        for k, width in enumerate(WIDTHS):
            here = out[:, k * self.n : (k + 1) * self.n]
            for j in range(width):
                block = np.ascontiguousarray(projected[:, col : col + self.n])
                if j == 0:
                    here[:] = block.take(at[0], 0)
                else:
                    here += block.take(at[j], 0)
                col += self.n
        return out

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.biases, 0) @ self.weights + self.bias

    def scaled(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * z + self.shift, -500, 500)))

    def scores(self, pooled: np.ndarray) -> np.ndarray:
        return self.scaled(self.logits(pooled).astype(np.float64))

    def pool(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text, the most that each filter says to any window of it; an empty text is a gap."""
        out = np.zeros((len(offsets) - 1, len(self.biases)), np.float32)
        for a, b in runs(offsets):
            base, stop = int(offsets[a]), int(offsets[b])
            if b - a == 1 and stop - base > SLICE_BYTES:
                out[a] = self._pool_long(data[base:stop])
            else:
                _, rows, tokens, counts, _ = words_of(data[base:stop], offsets[a : b + 1] - base)
                full = np.flatnonzero(counts)
                if len(full):
                    said = self.windows(self.words(rows) @ self.filters, following(tokens, counts, len(rows)))
                    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])[full]
                    out[a + full] = np.maximum.reduceat(said, firsts)
        return out

    def _pool_long(self, data: np.ndarray) -> np.ndarray:
        """One text in pieces that overlap by all but one word of the widest filter; windows that a piece cuts off belong to the next."""
        over, at, size, most = max(WIDTHS) - 1, 0, SLICE_BYTES, None
        while True:
            to = min(at + size, len(data))
            while to < len(data) and _FOLDED[data[to]] != 32:
                to += 1
            _, rows, tokens, counts, starts = words_of(data[at:to], np.array([0, to - at]))
            last = to == len(data)
            if not last and len(tokens) <= over:
                size *= 2
                continue
            if len(tokens):
                said = self.windows(self.words(rows) @ self.filters, following(tokens, counts, len(rows)))
                found = (said if last else said[: len(tokens) - over]).max(0)
                most = found if most is None else np.maximum(most, found)
            if last:
                return np.zeros(len(self.biases), np.float32) if most is None else most
            at, size = at + int(starts[len(tokens) - over]), SLICE_BYTES


def following(tokens: np.ndarray, counts: np.ndarray, gap: int) -> list[np.ndarray]:
    """The word at each token and at the tokens after it in the same text, as many as the widest filter sees; ``gap`` after its end."""
    left = np.repeat(np.cumsum(counts), counts) - np.arange(len(tokens))
    out = [tokens]
    for j in range(1, max(WIDTHS)):
        out.append(np.where(left > j, np.append(tokens[j:], np.full(min(j, len(tokens)), gap, tokens.dtype)), gap))
    return out


# --- training ------------------------------------------------------------------------------------------------------


class Corpus:
    """Labelled texts as numbers of their words, with the rows of the table that each word has."""

    def __init__(self):
        self.tokens: list[np.ndarray] = []
        self.labels: list[int] = []
        self.known: dict[int, int] = {}
        self.found: list[np.ndarray] = []

    def add(self, data: np.ndarray, offsets: np.ndarray, labels: list[int]) -> None:
        """Add texts in one array, about SLICE_BYTES of them at a time; a longer one in pieces, cut at white space."""
        for a, b in runs(offsets):
            at, stop, tokens = int(offsets[a]), int(offsets[b]), []
            if b - a > 1 or stop - at <= SLICE_BYTES:
                tok, counts = self._numbered(data[at:stop], offsets[a : b + 1] - at)
                self.tokens += [t.copy() for t in np.split(tok, np.cumsum(counts)[:-1])]
                continue
            while at < stop:
                to = min(at + SLICE_BYTES, stop)
                while to < stop and _FOLDED[data[to]] != 32:
                    to += 1
                tokens.append(self._numbered(data[at:to], np.array([0, to - at]))[0])
                at = to
            self.tokens.append(np.concatenate(tokens))
        self.labels += labels

    def _numbered(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words of texts as numbers, and how many each text has. New words are numbered text by text, and by hash within a text."""
        distinct, rows, tok, counts, _ = words_of(data, offsets)
        text = np.empty(len(distinct), np.int64)  # the first that has the word: of repeated places the last value stays
        text[tok[::-1]] = np.repeat(np.arange(len(counts)), counts)[::-1]
        order = np.argsort(text, kind="stable")  # distinct words are in the order of their hashes
        number, before = np.empty(len(distinct), np.int32), len(self.known)
        number[order] = [self.known.setdefault(h, len(self.known)) for h in distinct[order].tolist()]
        self.found.append(rows[order[number[order] >= before]])
        return number[tok], counts

    def rows(self) -> np.ndarray:
        return np.concatenate([np.zeros((0, FEATURES), np.int32), *self.found])

    def held(self) -> np.ndarray:
        """How many texts have each row of the table."""
        rows, out, last = self.rows(), np.zeros(BUCKETS + 1, np.int64), np.empty(BUCKETS + 1, np.int64)
        for tok in self.tokens:
            own = rows.take(tok, 0).ravel()
            place = np.arange(len(own))
            last[own] = place
            out[own[last[own] == place]] += 1  # each row once
        return out


@dataclass
class Learner:
    """A network and, for each of its numbers, the sum of the squares of its gradients (Adagrad); and what it draws from."""

    net: Network
    sums: dict[str, np.ndarray]
    rng: np.random.Generator

    @classmethod
    def fresh(cls, toxic: int, others: int, seed: int, dims: int = 16, per_width: int = 8) -> Learner:
        rng = np.random.default_rng(seed)
        n, total = per_width * len(WIDTHS), per_width * sum(WIDTHS)
        table = (0.05 * rng.standard_normal((BUCKETS + 1, dims))).astype(np.float32)
        table[BUCKETS] = 0
        filters = (rng.standard_normal((dims, total)) / np.sqrt(dims)).astype(np.float32)
        net = Network(table, filters, np.zeros(n, np.float32), (0.3 * rng.choice([-1, 1], n)).astype(np.float32), float(np.log((toxic + 1) / (others + 1))))
        return cls(net, {k: np.full(np.shape(getattr(net, k)), 1e-3, np.float32) for k in ("table", "filters", "biases", "weights", "bias")}, rng)

    def step(self, name: str, gradient, rate: float, at=slice(None)) -> None:
        if name == "bias":
            self.sums[name] = self.sums[name] + gradient**2
            self.net.bias -= rate * float(gradient) / float(np.sqrt(self.sums[name]))
            return
        self.sums[name][at] += gradient**2
        getattr(self.net, name)[at] -= rate * gradient / np.sqrt(self.sums[name][at])

    def learn(self, corpus: Corpus, used: np.ndarray, heavy: float, epochs: int, batch: int = 32, rate: float = 0.05, drop: float = 0.3) -> None:
        """Gradient descent with a step for each parameter on the cross entropy, in which toxic texts weigh ``heavy`` times as much. Rows of the
        table that aren't ``used`` stay zero. A share ``drop`` of the words is left out at random in each pass."""
        rng, net, tokens, labels = self.rng, self.net, corpus.tokens, np.array(corpus.labels, np.float64)
        n = len(net.biases)
        per_width, total = net.n, net.filters.shape[1]
        place = [(k, j) for k, w in enumerate(WIDTHS) for j in range(w)]
        rows = corpus.rows()
        rows = np.where(used[rows], rows, BUCKETS)
        for _ in range(epochs):
            order = rng.permutation(len(tokens))
            for a in range(0, len(order), batch):
                own = [tokens[i] for i in order[a : a + batch]]
                own = [t[rng.random(len(t)) >= drop] for t in own]
                y = labels[order[a : a + batch]]
                counts = np.array([len(t) for t in own])
                words, tok = np.unique(np.concatenate(own), return_inverse=True)
                tok = tok.astype(np.int32)
                vectors = net.words(rows[words])
                projected = vectors @ net.filters
                pooled = np.zeros((len(own), n), np.float32)
                touched = np.full((len(own), per_width, len(place)), len(words), np.int64)  # the words of the windows that say most: only these learn

                ends = np.concatenate([[0], np.cumsum(counts)])
                for d, e in runs(ends, TOKENS):
                    lo, hi = int(ends[d]), int(ends[e])
                    if hi - lo <= 2 * TOKENS:
                        full = d + np.flatnonzero(counts[d:e])
                        at = following(tok[lo:hi], counts[d:e], len(words))
                        found = net.windows(projected, at)
                        best = np.array([found[ends[i] - lo : ends[i + 1] - lo].argmax(0) + ends[i] - lo for i in full], np.int64).reshape(-1, n)
                        pooled[full] = found[best, np.arange(n)]
                        for p, (k, j) in enumerate(place):
                            touched[full, :, p] = at[j][best[:, k * per_width : (k + 1) * per_width]]
                        continue
                    pooled[d] = -np.inf  # one long text, in pieces
                    for first in range(lo, hi, TOKENS):
                        stop = min(first + TOKENS + max(WIDTHS) - 1, hi)
                        at = following(tok[first:stop], np.array([stop - first]), len(words))
                        found = net.windows(projected, at)[:TOKENS]
                        best = found.argmax(0)
                        newer = found[best, np.arange(n)] > pooled[d]
                        pooled[d] = np.where(newer, found[best, np.arange(n)], pooled[d])
                        for p, (k, j) in enumerate(place):
                            mine = slice(k * per_width, (k + 1) * per_width)
                            touched[d, :, p] = np.where(newer[mine], at[j][best[mine]], touched[d, :, p])
                hidden = np.maximum(pooled + net.biases, 0)
                error = (1 / (1 + np.exp(-(hidden @ net.weights + net.bias))) - y) * np.where(y == 1, heavy, 1.0) / len(own)
                back = (error[:, None] * net.weights * (hidden > 0) * (counts > 0)[:, None]).astype(np.float32)
                if len(tok):
                    seen, where = np.unique(touched, return_inverse=True)
                    grown = np.zeros((len(seen), total), np.float32)
                    where = where.reshape(touched.shape)
                    for c, (k, _) in enumerate(place):
                        np.add.at(grown, (where[:, :, c], c * per_width + np.arange(per_width)[None, :]), back[:, k * per_width : (k + 1) * per_width])
                    slopes = grown @ net.filters.T / FEATURES
                    filters = vectors[seen].T @ grown
                    inside = seen < len(words)
                    at_rows = rows[words[seen[inside]]]
                    r, back_rows = np.unique(at_rows, return_inverse=True)
                    gradient = np.zeros((len(r), net.table.shape[1]), np.float32)
                    np.add.at(gradient, back_rows.reshape(at_rows.shape), slopes[inside][:, None, :])
                    some = r < BUCKETS
                    self.step("filters", filters, rate)
                    self.step("table", gradient[some], rate, r[some])
                self.step("biases", back.sum(0), rate)
                self.step("weights", (hidden * error[:, None]).sum(0).astype(np.float32), rate)
                self.step("bias", error.sum(), rate)

    # --- in blocks: rows of the table with their sums, and all other numbers as the last

    def blocks(self) -> list[np.ndarray]:
        table = np.concatenate([self.net.table[:BUCKETS], self.sums["table"][:BUCKETS]], 1)
        rest = [np.ravel(x).astype(np.float32) for k in ("filters", "biases", "weights", "bias") for x in (getattr(self.net, k), self.sums[k])]
        return [*table.reshape(-1, ROWS, table.shape[1]), np.concatenate(rest)[None, :]]

    def take(self, block: int, values: np.ndarray, some: np.ndarray) -> None:
        """Set the numbers of a block, those in rows that are in ``some``."""
        values = values.reshape(len(some), -1)
        if block < BUCKETS // ROWS:
            at, dims = block * ROWS + np.flatnonzero(some), self.net.table.shape[1]
            self.net.table[at], self.sums["table"][at] = values[some, :dims], values[some, dims:]
            return
        at = 0
        for k in ("filters", "biases", "weights", "bias"):
            shape, size = np.shape(getattr(self.net, k)), np.size(getattr(self.net, k))
            new, sums = (values[0, at + i * size : at + (i + 1) * size].reshape(shape).copy() for i in (0, 1))
            setattr(self.net, k, new if k != "bias" else float(new))
            self.sums[k] = sums
            at += 2 * size


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Corpus]]:
    """The parts of rows sorted by part; one is held at a time."""
    now, corpus = None, Corpus()
    for batch in batches:
        part, labels = batch.column("part").to_numpy(), batch.column("toxic").to_pylist()
        data, offsets = utf8(batch.column("text"))
        edges = np.flatnonzero(np.diff(part)) + 1
        for a, b in zip([0, *edges.tolist()], [*edges.tolist(), len(part)], strict=True):
            if a == b:
                continue
            if part[a] != now and now is not None:
                yield now, corpus
                corpus = Corpus()
            now = int(part[a])
            corpus.add(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], labels[a:b])
    if now is not None:
        yield now, corpus


@frugal
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, corpus in _parts(batches):
        held = corpus.held()
        at = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(held[at])], ["bucket", "texts"])


def _learn(learner: Learner, used: np.ndarray, heavy: float, epochs: int, seed: int, turn: int):
    """Of each part, what the learner becomes by it, in blocks, with how many texts each row rests on."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, corpus in _parts(batches):
            own = copy.deepcopy(learner)
            if turn or part:
                own.rng = np.random.default_rng((seed, turn, part))
            own.learn(corpus, used, heavy, epochs)
            weights = [*(corpus.held() * used)[:BUCKETS].reshape(-1, ROWS), np.array([len(corpus.tokens)])]
            for i, (w, values) in enumerate(zip(weights, own.blocks(), strict=True)):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([part], pa.int64()), pa.array([w.astype(np.int64).tobytes()], pa.binary()), pa.array([values.tobytes()], pa.binary())], ["block", "part", "weights", "data"])

    return run


@frugal
def _average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Means of blocks by weight, over rows sorted by (block, part)."""
    now, weights, total = None, None, None

    def made() -> pa.RecordBatch:
        mean = total / np.maximum(weights, 1)[:, None]
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([weights.tobytes()], pa.binary()), pa.array([mean.astype(np.float32).tobytes()], pa.binary())], ["block", "weights", "data"])

    for batch in batches:
        for block, w, data in zip(batch.column("block").to_pylist(), batch.column("weights"), batch.column("data"), strict=True):
            w = np.frombuffer(w.as_buffer(), np.int64)
            values = w[:, None] * np.frombuffer(data.as_buffer(), np.float32).reshape(len(w), -1).astype(np.float64)
            if block != now:
                if now is not None:
                    yield made()
                now, weights, total = block, w.copy(), values
            else:
                weights, total = weights + w, total + values
    if now is not None:
        yield made()


def train(rows: DataFrame, parts: int, toxic: int, others: int, seed: int = 0, shown: int = 3) -> Network:
    """Fit a network to all rows (doc_id, toxic, text) in ``parts``. The rarer label weighs up to five times as much. Rows of the table that fewer than
    ``shown`` texts hold stay zero: they tell texts apart, not labels. Every round each part learns from the network of the round before; a row of the
    table becomes the mean of those that the parts have made of it, by the number of their texts that hold it, in the order of the parts."""
    dealt = rows.select("doc_id", "toxic", "text", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(parts)).cast("int").alias("part")).repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id")
    found = dealt.mapInArrow(_count, "bucket long, texts long").groupBy("bucket").agg(F.sum("texts").alias("texts")).toArrow()  # BUCKETS rows at most
    held = np.zeros(BUCKETS + 1, np.int64)
    held[found.column("bucket").to_numpy()] = found.column("texts").to_numpy()
    used = held >= shown
    used[BUCKETS] = False
    learner, heavy = Learner.fresh(toxic, others, seed), min(5.0, max(1.0, others / max(toxic, 1)))
    for turn in range(ROUNDS if parts > 1 else 1):
        made = dealt.mapInArrow(_learn(learner, used, heavy, PASSES if parts > 1 else EPOCHS, seed, turn), "block long, part long, weights binary, data binary")
        means = cut(made.repartition("block").sortWithinPartitions("block", "part").mapInArrow(_average, "block long, weights binary, data binary"), "toxicity-means")
        for r in means.collect():  # the size of the network
            learner.take(r.block, np.frombuffer(r.data, np.float32), np.frombuffer(r.weights, np.int64) > 0)
        drop_cut(means)
    learner.net.table[~used] = 0
    return learner.net


def pooled_texts(net: Network, texts: list[bytes]) -> np.ndarray:
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    return net.pool(np.frombuffer(b"".join(texts), np.uint8), offsets)


def calibrate(net: Network, z: np.ndarray, labels: np.ndarray, counts: np.ndarray) -> None:
    """Set the line from sums to logits by Platt's method on the sums of texts that weren't trained on, so that 0.5 parts the labels."""
    n1, n0 = (counts * labels).sum(), (counts * (1 - labels)).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    line = np.array([1.0, 0.0])
    x = np.stack([z, np.ones_like(z)], 1)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -500, 500)))
        curve = x.T @ (x * (counts * p * (1 - p))[:, None]) + 1e-3 * np.eye(2)
        move = np.linalg.solve(curve, x.T @ (counts * (p - target)) + 1e-3 * (line - [1.0, 0.0]))
        line -= move / max(1.0, np.abs(move).max())
        if np.abs(move).max() < 1e-9:
            break
    net.slope, net.shift = max(float(line[0]), 1e-3), float(line[1])


def best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The threshold with the best F1, half way to the next lower score. A score may stand for several texts."""
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    order = np.argsort(-scores, kind="stable")
    s, y, c = scores[order], labels[order], counts[order]
    hits, n = np.cumsum(c * y), np.cumsum(c)
    ends = np.flatnonzero(np.append(s[1:] != s[:-1], True))
    i = ends[np.argmax(2 * hits[ends] / (n[ends] + hits[-1]))]
    return float((s[i] + s[i + 1]) / 2) if i + 1 < len(s) else float(s[i])


# --- over tables ---------------------------------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % PARTS == HELD_OUT, F.lit(False))


class ToxicityModel:
    """A trained network with a threshold for each language that has ``enough`` toxic and other texts among those kept for calibration; other languages
    have the one of all texts (0.5 if those have one label only).

    Trained on all labelled rows of documents outside of the held-out part, whatever their number and length. A fifth of them isn't trained on but sets the
    scale and the thresholds, by counts of logits in fine steps. A document is toxic if any of its label rows says so; of repeated doc_ids the least text counts.
    Without labelled texts all scores are 0.5. ``learnt`` and ``checked`` say how many rows were used in either way.
    """

    def __init__(self, documents: DataFrame, labels: DataFrame, enough: int = 20, seed: int = 0):
        marks = own_columns(labels, "doc_id", "toxic").select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
        marks = marks.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        texts = own_columns(documents, "doc_id", "lang", "text").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
        texts = texts.where((F.octet_length("text") > 0) & ~held_out(F.col("doc_id"))).join(marks, "doc_id").groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.min_by(F.struct("lang", "text"), "text").alias("t"))

        @frugal
        def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.append_column("checked", pa.array(mix(batch.column("doc_id").to_numpy(), seed) % np.uint64(5) == 0))

        rows = cut(texts.select("doc_id", "toxic", "t.*").mapInArrow(split, "doc_id long, toxic int, lang string, text string, checked boolean"), "toxicity-rows")
        sizes = {(r.checked, r.toxic): r for r in rows.groupBy("checked", "toxic").agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).collect()}
        n = lambda *key: sizes[key].n if key in sizes else 0
        self.learnt, self.checked = (n(c, 0) + n(c, 1) for c in (False, True))
        parts = max(1, -(-sum(r.bytes for (c, _), r in sizes.items() if not c) // PART_BYTES))
        self.network = train(rows.where("not checked"), parts, n(False, 1), n(False, 0), seed)
        self.thresholds: dict[str | None, float] = {}
        self.threshold = 0.5
        if self.checked:
            self._check(rows.where("checked"), enough)
        drop_cut(rows)

    def _check(self, rows: DataFrame, enough: int) -> None:
        """Set the scale and the thresholds from rows that weren't trained on."""
        network = self.network

        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                z = network.logits(network.pool(*utf8(batch.column("text")))).astype(np.float64)
                yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("toxic"), pa.array(z)], ["lang", "toxic", "z"])

        named = sorted(r.lang for r in rows.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.sum("toxic").alias("y"), F.sum(1 - F.col("toxic")).alias("x")).where(F.least("x", "y") >= enough).collect())
        found = rows.select("lang", "toxic", "text").mapInArrow(run, "lang string, toxic int, z double").withColumn("lang", F.coalesce("lang", F.lit("")))
        step = F.round(F.greatest(F.lit(-FAR), F.least(F.lit(FAR), F.col("z"))) * STEPS).cast("long")
        own = F.when(F.col("lang").isin(named), F.col("lang")) if named else F.lit(None).cast("string")
        rest = found.groupBy(own.alias("lang"), "toxic", step.alias("step")).agg(F.count("*").alias("n"), F.min("z").alias("low"), F.max("z").alias("high")).orderBy("step", "toxic", "lang").collect()
        z, y, n = np.array([(r.low + r.high) / 2 for r in rest]), np.array([r.toxic for r in rest]), np.array([r.n for r in rest])
        if len(set(y)) == 2:
            calibrate(network, z, y, n)
            scores = network.scaled(z)
            self.threshold = best_threshold(scores, y, n)
            for name in named:
                here = np.array([r.lang == name for r in rest])
                self.thresholds[name] = best_threshold(scores[here], y[here], n[here])

    def score(self, documents: DataFrame) -> DataFrame:
        """doc_id, held_out, score, predicted, threshold, flagged: see ``toxicity``."""
        broadcast = documents.sparkSession.sparkContext.broadcast(self.network)

        @frugal
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net = broadcast.value
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), pa.array(net.scores(net.pool(*utf8(batch.column("text")))), pa.float64())], ["doc_id", "lang", "score"])

        rows = own_columns(documents, "doc_id", "lang", "text").select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.col("text").cast("string"))
        threshold = F.lit(self.threshold)
        for name, t in self.thresholds.items():
            threshold = F.when(F.coalesce("lang", F.lit("")) == name, F.lit(t)).otherwise(threshold)
        scored = rows.mapInArrow(run, "doc_id long, lang string, score double").withColumn("threshold", threshold)
        return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "threshold", (F.col("score") >= F.col("threshold")).alias("flagged"))


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each row of documents: doc_id, held_out (crc32 of the doc_id in decimals is a multiple of 5: nothing is learnt from its label), score
    (0 to 1, from the whole text alone), predicted (1 from 0.5 on), and the threshold of the row's language with flagged, whether the score reaches it.

    Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case. Filters see one to three words; of each the
    greatest value anywhere in the text counts, so a text of any length is read whole, in pieces. A null text is an empty one and has the
    score of no words. Null doc_ids are never held out nor learnt from; repeated rows score alike; other columns are ignored.
    """
    return ToxicityModel(documents, labels).score(documents)
