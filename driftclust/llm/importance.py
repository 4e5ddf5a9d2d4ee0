"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftclust.llm.common import LOWER, SLICE_BYTES, SPACE, cut, drop_cut, frugal, mix, own_columns, packed, runs, span_hashes, utf8, word_spans

#: Buckets of each kind of n-gram: single words, pairs of words, the first PREFIX bytes of words.
BUCKETS = 1 << 16
KINDS = 3
PREFIX = 5
#: Classes of length: the power of two of the number of words plus 1.
CLASSES = 64


def _parts(data: np.ndarray, at: int, stop: int) -> Iterator[tuple[int, int]]:
    """A long text in pieces of about SLICE_BYTES that end where a word ends."""
    while at < stop:
        to = min(at + SLICE_BYTES, stop)
        while to < stop and not SPACE[data[to : to + 4096]].any():
            to = min(to + 4096, stop)
        if to < stop:
            to += int(np.argmax(SPACE[data[to : to + 4096]]))
        yield at, to
        at = to


def _buckets(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, row of each n-gram counted from there, its bucket) for slices of a column; A-Z lowered. A text longer than a slice comes
    in several: cut between words, with the pair across the cut."""
    data, offsets = utf8(column)
    for a, b in runs(offsets):
        begin, stop = int(offsets[a]), int(offsets[b])
        whole = stop - begin <= 2 * SLICE_BYTES
        before = np.zeros(0, np.uint64)  # the last word of the same text
        for at, to in [(begin, stop)] if whole else _parts(data, begin, stop):
            part = LOWER[data[at:to]]
            starts, ends, counts = word_spans(part, offsets[a : b + 1] - at if whole else np.array([0, to - at]))
            row = np.repeat(np.arange(b - a), counts)
            word = span_hashes(part, starts, ends)
            head = span_hashes(part, starts, np.minimum(starts + PREFIX, ends))
            run, of = np.concatenate((before, word)), np.concatenate((np.zeros(len(before), np.int64), row))
            pair = of[1:] == of[:-1]
            with np.errstate(over="ignore"):
                two = mix(run[:-1] * np.uint64(3) + run[1:], 41)[pair]
            kinds = [mix(word, 43), two, mix(head, 47)]
            found = np.concatenate([(k & np.uint64(BUCKETS - 1)).astype(np.int64) + i * BUCKETS for i, k in enumerate(kinds)])
            yield a, np.concatenate((row, of[1:][pair], row)), found
            before = before if whole else run[-1:]


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return np.ascontiguousarray(batch.column("doc_id").cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False))


def _count(fit: np.ndarray):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(KINDS * BUCKETS, np.int64), np.zeros(KINDS * BUCKETS, np.int64)
        for batch in batches:
            chosen = np.isin(_ids(batch), fit)
            for first, row, bucket in _buckets(batch.column("text")):
                raw += np.bincount(bucket, minlength=len(raw))
                target += np.bincount(bucket[chosen[first + row]], minlength=len(raw))
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], ["bucket", "raw", "target"])

    return run


class Models:
    """The raw text's and the target's model, from counts of hashed n-grams; ``fit`` has the ids of the target's documents.

    A bucket's share is its count, plus a pseudo-count of one, of its kind's. The target's model backs off to the raw one where the counts don't
    tell them apart: where the target's count is less than ``doubt`` standard deviations from what the raw share lets expect, or the shares differ
    by less than a factor of exp(``margin``). Without that, rare words, which any text has, would outweigh the telling ones.
    """

    def __init__(self, raw: np.ndarray, target: np.ndarray, fit: np.ndarray, margin: float, doubt: float):
        self.raw, self.target, self.fit, self.margin, self.doubt = raw.astype(float), target.astype(float), np.sort(fit), margin, doubt
        self.sums = [x.reshape(KINDS, BUCKETS).sum(axis=1) for x in (self.raw, self.target)]
        bucket = np.arange(KINDS * BUCKETS)
        self.ratio = self.log_ratio(bucket, self.target, self.sums[1][bucket // BUCKETS])

    def log_ratio(self, bucket: np.ndarray, target: np.ndarray, sums: np.ndarray) -> np.ndarray:
        """Log of the target's share over the raw share of buckets, for target counts and their sums over the kind."""
        raw, all_raw = self.raw[bucket], self.sums[0][bucket // BUCKETS]
        ratio = np.log((target + 1) / (sums + BUCKETS)) - np.log((raw + 1) / (all_raw + BUCKETS))
        expected = raw / np.maximum(all_raw, 1) * sums
        return np.where((np.abs(ratio) >= self.margin) & (np.abs(target - expected) >= self.doubt * np.sqrt(expected + 1)), ratio, 0.0)

    def scores(self, column: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The sum of the log ratios over all n-grams of each text, and its length class. A text of the target is judged by the target
        without it, so that it is on a par with others of its kind."""
        total, words = np.zeros(len(column)), np.zeros(len(column), np.int64)
        own = np.isin(ids, self.fit)
        parts: dict[int, list[np.ndarray]] = {}  # of target texts, slice by slice
        for first, row, bucket in _buckets(column):
            sums = np.bincount(row, weights=self.ratio[bucket])
            total[first : first + len(sums)] += sums
            words[first : first + len(sums)] += np.bincount(row[bucket < BUCKETS], minlength=len(sums))
            mine = own[first + row]
            if mine.any():
                key, n = np.unique((first + row[mine]) * np.int64(KINDS * BUCKETS) + bucket[mine], return_counts=True)
                for at, group in zip(*_groups(key // (KINDS * BUCKETS)), strict=True):
                    parts.setdefault(at, []).append(np.stack((key[group] % (KINDS * BUCKETS), n[group])))
        for at, found in parts.items():
            bucket, where = np.unique(np.concatenate([f[0] for f in found]), return_inverse=True)
            n = np.bincount(where, weights=np.concatenate([f[1] for f in found]))
            kind = bucket // BUCKETS
            sums = self.sums[1] - np.bincount(kind, weights=n, minlength=KINDS)
            total[at] = (self.log_ratio(bucket, self.target[bucket] - n, sums[kind]) * n).sum()
        return np.round(total, 6), np.floor(np.log2(words + 1)).astype(np.int32)


def _groups(sorted_: np.ndarray) -> tuple[list[int], list[slice]]:
    edges = np.flatnonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1]))).tolist()
    return sorted_[edges].tolist(), [slice(a, b) for a, b in zip(edges, [*edges[1:], len(sorted_)], strict=True)]


def _gumbel(ids: np.ndarray, seed: int) -> np.ndarray:
    """Standard Gumbel noise of each id, the same wherever it is drawn."""
    u = ((mix(ids.view(np.uint64), seed) >> np.uint64(11)).astype(float) + 0.5) / (1 << 53)
    return -np.log(-np.log(u))


def _score(models: Models, seed: int):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            weight, length = models.scores(batch.column("text"), ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(weight), pa.array(weight + _gumbel(ids, seed)), pa.array(length)], ["doc_id", "log_weight", "key", "length_class"])

    return run


def _draw(models: Models, seed: int, least: np.ndarray):
    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _ids(batch)
            weight, length = models.scores(batch.column("text"), ids)
            yield batch.filter(pa.array(weight + _gumbel(ids, seed) >= least[length]))

    return run


def kth_largest(values: DataFrame, group: str, column: str, ks: dict[int, int], few: int = 4096) -> dict[int, float]:
    """The k-th largest value of a column in each group, exactly, for all groups at once. The ranges that hold them are narrowed by counts over
    1024 bins until ``few`` values are left in each, which alone come to the driver; equal values end a group's search early."""
    spark = values.sparkSession
    ends = {r[0]: [r[1], r[2], 0] for r in values.groupBy(group).agg(F.min(column), F.max(column)).collect() if ks.get(r[0])}  # low, high, values above
    found: dict[int, float] = {}
    while True:
        found |= {g: low for g, (low, high, _) in ends.items() if low == high}
        ends = {g: e for g, e in ends.items() if g not in found}
        if not ends:
            return found
        ranges = F.broadcast(spark.createDataFrame([(g, e[0], e[1]) for g, e in ends.items()], "g int, low double, high double"))  # groups
        inside = values.join(ranges, F.col(group) == F.col("g")).where(F.col(column).between(F.col("low"), F.col("high")))
        number = F.least(F.lit(1023), F.floor((F.col(column) - F.col("low")) / ((F.col("high") - F.col("low")) / 1024))).cast("int")
        bins = inside.groupBy("g", number.alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).sort(F.desc("bin")).collect()
        narrow = set()
        for g, e in ends.items():
            mine = [b for b in bins if b.g == g]
            if sum(b.n for b in mine) <= few:
                narrow.add(g)
                continue
            for b in mine:
                if e[2] + b.n >= ks[g]:
                    e[0], e[1] = b.lo, b.hi
                    break
                e[2] += b.n
        if narrow:
            left: dict[int, list[float]] = {}
            for r in inside.where(F.col("g").isin(*narrow)).select("g", column).collect():  # few of each group
                left.setdefault(r[0], []).append(r[1])
            found |= {g: sorted(v, reverse=True)[ks[g] - ends[g][2] - 1] for g, v in left.items()}
            ends = {g: e for g, e in ends.items() if g not in found}


def best_threshold(clean: np.ndarray, bad: np.ndarray, cost: float = 20.0) -> float:
    """The score that parts labelled rows best when a clean row lost counts as much as ``cost`` bad ones kept; midway in its gap."""
    scores = np.concatenate((clean, bad))
    order = np.argsort(scores, kind="stable")
    is_bad = np.concatenate((np.zeros(len(clean)), np.ones(len(bad))))[order]
    gain = np.concatenate(([0.0], np.cumsum(is_bad / max(len(bad), 1) - cost * (1 - is_bad) / max(len(clean), 1))))
    sorted_ = scores[order]
    fair = np.concatenate(([True], sorted_[1:] > sorted_[:-1], [True]))
    at = int(np.argmax(np.where(fair, gain, -np.inf)))
    if at == 0:
        return float(sorted_[0]) - 1.0
    return float(sorted_[at - 1]) + 1e-6 if at == len(sorted_) else float(sorted_[at - 1] + sorted_[at]) / 2


def strata(clean: np.ndarray, bad: np.ndarray, support: int) -> np.ndarray:
    """The stratum of each length class: neighbouring classes are put together until they have ``support`` labelled documents of either kind; what
    is left at the end joins the last."""
    counts = [np.bincount(x, minlength=CLASSES) for x in (clean, bad)]
    out, now, have = np.zeros(CLASSES, np.int64), 0, np.zeros(2)
    for c in range(CLASSES):
        out[c] = now
        have += [counts[0][c], counts[1][c]]
        if have.min() >= support:
            now, have = now + 1, np.zeros(2)
    out[out == now] = max(now - 1, 0)
    return out


class Resampler:
    """The fitted classifier: ``scored`` has doc_id, log_weight, key and length_class of every row, ``least`` the key of each length class from
    which rows are kept."""

    def __init__(self, documents: DataFrame, labels: DataFrame, sample: int = 20_000, margin: float = 0.5, doubt: float = 4.0, support: int = 20, seed: int = 7):
        docs = own_columns(documents, "doc_id", "text").select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
        marks = own_columns(labels, "doc_id", "quality", "toxic").select(F.col("doc_id").cast("long"), (F.coalesce(F.col("quality").cast("int"), F.lit(0)) == 1).alias("good"), (F.coalesce(F.col("toxic").cast("int"), F.lit(0)) == 1).alias("toxic"))
        marks = marks.where("doc_id is not null").groupBy("doc_id").agg((F.min("good") & ~F.max("toxic")).alias("clean"))
        pick = lambda clean: np.array([r[0] for r in marks.where(F.col("clean") == clean).sort(F.xxhash64("doc_id"), "doc_id").limit(sample).select("doc_id").collect()], np.int64)
        fit, bad = pick(True), pick(False)  # ``sample`` ids at most
        counts = docs.mapInArrow(_count(fit), "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
        table = counts.toPandas()  # KINDS * BUCKETS rows at most
        raw, target = np.zeros(KINDS * BUCKETS), np.zeros(KINDS * BUCKETS)
        raw[table.bucket], target[table.bucket] = table.raw, table.target
        fitted = bool(target.any())
        self.seed, self.models = seed, Models(raw, target if fitted else raw, fit, margin, doubt)
        self.scored = cut(docs.mapInArrow(_score(self.models, seed), "doc_id long, log_weight double, key double, length_class int"), "scored")
        self.least = np.full(CLASSES, -np.inf)
        if not fitted or not len(bad):
            return
        known = documents.sparkSession.createDataFrame([(int(i), c) for ids, c in ((fit, True), (bad, False)) for i in ids], "l_id long, clean boolean")
        known = self.scored.join(F.broadcast(known), F.col("doc_id") == F.col("l_id")).groupBy("l_id").agg(F.first("clean").alias("clean"), F.min("log_weight").alias("log_weight"), F.min("length_class").alias("length_class")).toPandas()
        clean, length, weight = known.clean.to_numpy(bool), known.length_class.to_numpy(), known.log_weight.to_numpy()
        if clean.all():
            return
        stratum = strata(length[clean], length[~clean], support)
        of = stratum[length]
        cuts = {int(s): best_threshold(weight[clean & (of == s)], weight[~clean & (of == s)]) for s in np.unique(stratum)}
        rows = self.scored.select("log_weight", "key", F.get(F.array(*(F.lit(int(s)) for s in stratum)), F.col("length_class")).alias("stratum"))
        reached = F.col("log_weight") >= F.get(F.array(*(F.lit(cuts[s]) for s in sorted(cuts))), F.col("stratum"))
        ks = {r.stratum: r.k for r in rows.groupBy("stratum").agg(F.count_if(reached).alias("k")).collect()}
        least = kth_largest(rows, "stratum", "key", ks)
        self.least = np.array([least.get(int(s), np.inf) for s in stratum])

    def kept(self) -> Column:
        """Whether a row of ``scored`` is drawn."""
        return F.col("key") >= F.get(F.array(*(F.lit(float(x)) for x in self.least)), F.col("length_class"))

    def keep(self, documents: DataFrame) -> DataFrame:
        """The rows of ``documents`` that were drawn, with the columns that they have."""
        base, back = packed(documents, "doc_id", "text")
        return base.mapInArrow(_draw(self.models, self.seed, self.least), base.schema).select(*map(back, documents.columns))

    def close(self) -> None:
        """Delete ``scored``."""
        drop_cut(self.scored)


def importance_resample(documents: DataFrame, labels: DataFrame, sample: int = 20_000, margin: float = 0.5, doubt: float = 4.0, support: int = 20, seed: int = 7) -> DataFrame:
    """Importance weights of whole texts and the rows that are drawn: doc_id, log_weight, key, length_class, kept; a row for each row.

    The raw model counts hashed words, word pairs and word heads of all documents, the target model those of a sample of at most
    ``sample`` documents labelled good and not toxic. log_weight is the log of the ratio of a text's probabilities under the two, the plain sum over
    all its n-grams (see ``Models``). Rows are drawn without replacement in proportion to their weights by Gumbel top-k: those with the k
    largest keys, log_weight plus Gumbel noise of the doc_id. As a sum's spread grows with the text, rows are drawn stratum by stratum, from
    length classes (the power of two of the words, plus 1) with ``support`` labelled documents of either kind, smaller ones together. k of a stratum
    is the number of its rows whose log_weight reaches the threshold that parts its labelled documents best (at most ``sample`` good and
    as many bad ones, a good one lost counting as 20 bad ones kept); equal keys at the end of the draw all count.

    A null or empty text has weight 0. Without labelled good documents, or without bad ones, all rows are kept. A document is good
    if all of its labels say so; null labels say bad, null toxic marks not toxic. Null ids share their noise. Repeated rows have equal
    keys. Other columns are ignored.
    """
    r = Resampler(documents, labels, sample, margin, doubt, support, seed)
    return r.scored.withColumn("kept", r.kept())
