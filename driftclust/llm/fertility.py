"""Quality rules from a tokenizer's view of a text: characters per token, byte-fallback share, entropy of the tokens."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from driftclust.llm.common import SPACE, cut, mix, own_columns, utf8
from driftclust.llm.tokens import text_chunks, vocabulary_path

#: Characters that count as symbols.
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
WINDOW = 8
#: Random odd factors: a window's hash is the sum of its word numbers times these.
_FACTORS = mix(np.arange(WINDOW, dtype=np.uint64), 91) | np.uint64(1)
#: Words a worker remembers with their tokens.
REMEMBERED = 1 << 20


class WordTokens:
    """Tokens of words under a sentencepiece vocabulary: each distinct word is encoded once, by itself, and numbered."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.is_byte = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.forget()

    def forget(self) -> None:
        self.number: dict[bytes, int] = {}
        self.starts, self.flat = np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.int32)  # both grow by doubling

    def learn(self, words: list[bytes]) -> None:
        new = [w for w in set(words) if w not in self.number]
        if not new:
            return
        coded = self.model.encode([w.decode("utf-8") for w in new], num_threads=1)
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        old = len(self.number)
        self.number.update(zip(new, range(old, old + len(new)), strict=True))
        while old + len(new) >= len(self.starts):
            self.starts = np.concatenate((self.starts, np.zeros_like(self.starts)))
        at = int(self.starts[old])
        self.starts[old + 1 : old + 1 + len(new)] = at + np.cumsum(sizes)
        end = at + int(sizes.sum())
        while end > len(self.flat):
            self.flat = np.concatenate((self.flat, np.zeros_like(self.flat)))
        self.flat[at:end] = np.fromiter(chain.from_iterable(coded), np.int32, end - at)

    def numbers(self, words: list[bytes]) -> np.ndarray:
        self.learn(words)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def tokens(self, numbers: np.ndarray) -> np.ndarray:
        """The tokens of a sequence of words by their numbers."""
        starts, sizes = self.starts[numbers], self.starts[numbers + 1] - self.starts[numbers]
        ends = np.cumsum(sizes)
        return self.flat[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]


def repeated_words(numbers: np.ndarray, window: int = WINDOW) -> int:
    """Words that lie in a window of words found twice or more in the text."""
    n = len(numbers) - window + 1
    if n < 2:
        return 0
    words = numbers.view(np.uint64)
    h = words[:n] * _FACTORS[0]
    for i in range(1, window):
        h += words[i : n + i] * _FACTORS[i]
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(n + window, np.int64)
    edge[:n] += twice
    edge[window : window + n] -= twice
    return int((np.cumsum(edge) > 0).sum())


_WORDS: dict[str, WordTokens] = {}

_MEASURES = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_tokens long, n_byte_tokens long, token_entropy double"


def _measure(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if vocabulary not in _WORDS:
            _WORDS[vocabulary] = WordTokens(vocabulary_path(vocabulary))
        model = _WORDS[vocabulary]
        for batch in batches:
            data, ends = utf8(batch.column("text"))
            rows = []
            for row in range(batch.num_rows):
                part = data[ends[row] : ends[row + 1]]
                raw = part.tobytes()
                numbers = [model.numbers(chunk.split()) for chunk in text_chunks(raw)]
                numbers = np.concatenate(numbers) if len(numbers) > 1 else numbers[0]
                tokens = model.tokens(numbers)
                counts = np.bincount(tokens, minlength=0) if len(tokens) > 4096 else np.unique(tokens, return_counts=True)[1]
                share = counts[counts > 0] / max(len(tokens), 1)
                lines = [x for x in raw.split(b"\n") if x.strip()]
                rows.append(
                    (
                        len(numbers),
                        int(np.count_nonzero(~SPACE[part] & ((part & 0xC0) != 0x80))),
                        int(np.count_nonzero(SYMBOLS[part])),
                        len(lines) - len(set(lines)),
                        repeated_words(numbers),
                        len(tokens),
                        int(np.count_nonzero(model.is_byte[tokens])),
                        float(-(share * np.log2(share)).sum()) if len(tokens) else 0.0,
                    )
                )
                if len(model.number) > REMEMBERED:
                    model.forget()
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("lang"), *(pa.array(c, pa.int64()) for c in columns[:7]), pa.array(columns[7], pa.float64())], [x.split()[0] for x in _MEASURES.split(", ")])

    return run


def _pools(cells: DataFrame, support: int) -> DataFrame:
    """(lang_key, length_class, pool, radius, slope, middle) for each cell: the texts that its band is made of.

    A pool is a language, or the whole corpus (``*``) where the language has fewer than ``support`` texts, within ``radius`` length classes of
    the cell: the least radius that reaches ``support``, or all. slope is how entropy rises with the logarithm of the number of tokens
    there, between 0 and 1, and middle the mean of the logarithm; a pool of one class has the slope 0.
    """
    sums = ["texts", "x", "y", "xx", "xy"]
    listed = F.collect_list(F.struct("length_class", *sums)).alias("cells")
    by_lang = cells.groupBy("lang_key").agg(F.sum("texts").alias("total"), listed)
    corpus = cells.groupBy("length_class").agg(*(F.sum(c).alias(c) for c in sums)).agg(listed)
    mine = cells.select("lang_key", "length_class").join(by_lang, "lang_key")
    own = mine.where(F.col("total") >= support).select("lang_key", "length_class", F.col("lang_key").alias("pool"), "cells")
    rare = mine.where(F.col("total") < support).select("lang_key", "length_class", F.lit("*").alias("pool")).crossJoin(corpus)  # one row on the right
    near = "filter(cells, c -> abs(c.length_class - length_class) <= {})"
    found = own.unionByName(rare).withColumn("radius", F.expr(f"coalesce(array_min(filter(sequence(0, 63), r -> aggregate({near.format('r')}, 0L, (s, c) -> s + c.texts) >= {support})), 63)"))
    found = found.withColumn("near", F.expr(near.format("radius")))
    for c in sums:
        found = found.withColumn(c, F.expr(f"aggregate(near, 0D, (s, c) -> s + c.{c})"))
    slope = F.expr("least(1D, greatest(0D, try_divide(texts * xy - x * y, texts * xx - x * x)))")
    return found.select("lang_key", "length_class", "pool", "radius", F.when(F.col("radius") == 0, 0.0).otherwise(F.coalesce(F.round(slope, 6), F.lit(0.0))).alias("slope"), F.round(F.col("x") / F.col("texts"), 6).alias("middle"))


#: Steps of a measure that are counted first; only the values of the step that holds a rank are counted one by one.
STEPS = 10_000


def exact_ranks(values: DataFrame, group: list[str], value: str, shares: list[float]) -> DataFrame:
    """(group, share, value): for each share p the value of rank ceil(p * n) among the n values of a group, the first at least.

    Values are counted by steps of 1 / STEPS on the map side, and then only those in a step that holds a sought rank one by one; a group's counts,
    not its rows, are put in order.
    """
    stepped = values.withColumn("__step", F.floor(F.col(value) * STEPS))
    up = W.partitionBy(*group).orderBy("__step")
    steps = stepped.groupBy(*group, "__step").agg(F.count("*").alias("__n")).select("*", F.sum("__n").over(up).alias("__to"), F.sum("__n").over(W.partitionBy(*group)).alias("__all"))
    sought = steps.select("*", F.explode(F.array(*map(F.lit, shares))).alias("share")).withColumn("__rank", F.greatest(F.lit(1), F.ceil(F.col("share") * F.col("__all"))))
    sought = sought.where((F.col("__rank") <= F.col("__to")) & (F.col("__rank") > F.col("__to") - F.col("__n"))).select(*group, "__step", "share", (F.col("__rank") - F.col("__to") + F.col("__n")).alias("__rank"))
    inside = stepped.join(sought.select(*group, "__step").distinct(), [*group, "__step"]).groupBy(*group, "__step", value).agg(F.count("*").alias("__n"))
    inside = inside.withColumn("__to", F.sum("__n").over(W.partitionBy(*group, "__step").orderBy(value)))
    return inside.join(sought, [*group, "__step"]).where(F.col("__to") >= F.col("__rank")).groupBy(*group, "share").agg(F.min(value).alias(value))


def fertility_verdicts(documents: DataFrame, vocabulary: str = "piece_bpe_32k.model", fences: tuple[float, float, float] = (4.0, 3.0, 8.0), support: int = 100) -> DataFrame:
    """Measures of every whole text and whether it is kept; a row for each row.

    Words are ``[^\\x20\\x09-\\x0D]+``. base_failed: fewer than 20 words, or over 30 % of the words in repeated 8-word windows.
    Beyond that a text is rejected when its characters per token or its token entropy lie outside, or its share of byte-fallback
    tokens lies above, the band of its language and length class (the power of two of its number of tokens): the quartiles of all
    texts of that class that didn't fail, widened by a multiple of their distance. ``fences`` has the multiples: below for characters per
    token, below for entropy, and above for all, where texts of names and numbers lie and much room is left. The quartiles are exact
    over all rows, so no verdict rests on how the rows are dealt.

    Every text that didn't fail is judged. A class of fewer than ``support`` texts has the band of the nearest classes on both sides that
    make up ``support`` together, with their entropies moved along their common trend to one length; a language of fewer than ``support``
    texts in all has that of the whole corpus, taken in the same way. A corpus below ``support`` is judged as a whole. A text
    without any token isn't kept.

    A null or empty text has no words and fails. A null language is a language of its own. Null and repeated ids return as they
    are; other columns are ignored.
    """
    docs = own_columns(documents, "doc_id", "text", "lang").select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    found = cut(docs.mapInArrow(_measure(vocabulary), _MEASURES), "fertility")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    found = found.select(
        "*",
        failed.alias("base_failed"),
        F.try_divide("word_chars", "n_tokens").alias("chars_per_token"),
        F.coalesce(F.try_divide("n_byte_tokens", "n_tokens"), F.lit(0.0)).alias("byte_share"),
        F.log2(F.greatest("n_tokens", F.lit(1))).alias("length"),
        F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), "lang")).alias("lang_key"),
    ).withColumn("length_class", F.floor("length").cast("int"))
    measures = ("chars_per_token", "byte_share", "level")
    level = F.col("token_entropy") + F.col("slope") * (F.col("middle") - F.col("length"))
    fit = found.where(~F.col("base_failed")).select("lang_key", "length_class", "length", "chars_per_token", "byte_share", "token_entropy")
    x, y = F.col("length"), F.col("token_entropy")
    cells = fit.groupBy("lang_key", "length_class").agg(F.count("*").alias("texts"), F.sum(x).alias("x"), F.sum(y).alias("y"), F.sum(x * x).alias("xx"), F.sum(x * y).alias("xy"))
    pools = cut(_pools(cut(cells, "cells"), support), "pools")
    bands = pools.select("pool", F.col("length_class").alias("middle_class"), "radius", "slope", "middle").distinct()
    near = bands.select("*", F.explode(F.expr("sequence(middle_class - radius, middle_class + radius)")).alias("length_class"))
    near = near.groupBy("pool", "length_class").agg(F.collect_list(F.struct("middle_class", "slope", "middle")).alias("bands"))
    drawn = fit.select("*", F.explode(F.array("lang_key", F.lit("*"))).alias("pool")).join(near, ["pool", "length_class"]).select("*", F.explode("bands").alias("b")).select("*", "b.*")
    values = drawn.withColumn("level", level).select("pool", "middle_class", F.posexplode(F.array(*measures)).alias("measure", "value"))
    found_ranks = exact_ranks(values, ["pool", "middle_class", "measure"], "value", [0.25, 0.75])
    of = lambda i: F.array(*(F.max(F.when((F.col("measure") == i) & (F.col("share") == p), F.col("value"))) for p in (0.25, 0.75)))
    quartiles = found_ranks.groupBy("pool", "middle_class").agg(*(of(i).alias(m) for i, m in enumerate(measures)))
    edge = lambda m, fence: fence * F.greatest(F.col(m)[1] - F.col(m)[0], F.abs(F.col(m)[1]) * 0.02)
    bands = quartiles.select(
        "pool",
        F.col("middle_class").alias("length_class"),
        (F.col("chars_per_token")[0] - edge("chars_per_token", fences[0])).alias("cpt_low"),
        (F.col("chars_per_token")[1] + edge("chars_per_token", fences[2])).alias("cpt_high"),
        (F.col("byte_share")[1] + F.greatest(edge("byte_share", fences[2]), F.lit(0.02))).alias("byte_high"),
        (F.col("level")[0] - edge("level", fences[1])).alias("entropy_low"),
        (F.col("level")[1] + edge("level", fences[2])).alias("entropy_high"),
    )
    judged = found.join(pools.join(bands, ["pool", "length_class"]), ["lang_key", "length_class"], "left")
    inside = F.col("chars_per_token").between(F.col("cpt_low"), F.col("cpt_high")) & (F.col("byte_share") <= F.col("byte_high")) & level.between(F.col("entropy_low"), F.col("entropy_high"))
    kept = ~F.col("base_failed") & F.coalesce(inside, F.lit(False))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_tokens", "chars_per_token", "byte_share", "token_entropy")
