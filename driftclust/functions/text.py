"""Text preprocessing as column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftclust.config import Preprocess
from driftclust.session import dealt, spread

# What counts as personal data and its token, in the order of replacement.
PII_PATTERNS = (
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
    (r"\b(?:\d[ -]?){13,19}\b", "[CARD]"),
    (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    (r"(?<!\w)\+?\d{1,3}?[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}\b", "[PHONE]"),
    (r"https?://\S+", "[URL]"),
)


def collapse_spaces(text: Column) -> Column:
    """Runs of Unicode white space as one space, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def compatibility_form(text: Column) -> Column:
    """Unicode NFKC, which Spark lacks. ASCII texts skip Python."""

    @F.pandas_udf("string")
    def nfkc(s: pd.Series) -> pd.Series:
        return s.map(lambda x: x if x is None or x.isascii() else unicodedata.normalize("NFKC", x))

    return nfkc(text)


def normalize_text(text: Column) -> Column:
    return collapse_spaces(compatibility_form(text))


def redact(text: Column) -> Column:
    """Personal data as tokens; digits and word borders as Unicode has them."""
    for pattern, token in PII_PATTERNS:
        text = F.regexp_replace(text, F.lit(f"(?U){pattern}"), F.lit(token))
    return text


def preprocess(items: DataFrame, how: Preprocess, hook: Callable[[Column], Column] | None = None) -> DataFrame:
    """``items`` with their text normalised, redacted, passed through ``hook`` and cut to length, as configured."""
    text = F.col("text")
    if how.normalize:
        text = normalize_text(text)
    if how.redact_pii:
        text = redact(text)
    if hook is not None:
        text = hook(text)
    if how.max_chars:
        text = F.substring(text, 1, how.max_chars)
    return items.withColumn("text", text)


_WORD = re.compile("[a-z0-9]+")
#: Distinct features that a task holds before it gives their counts away.
HELD = 1 << 18


def words_of(text: str | None) -> list[str]:
    """Words ``[a-z0-9]+`` of the lower-cased text."""
    return _WORD.findall(text.lower()) if text else []


def pairs_of(words: list[str]) -> Iterator[str]:
    """Neighbours joined by ``_``."""
    return map("_".join, zip(words, words[1:], strict=False))


def trigrams_of(word: str) -> list[str]:
    """The trigrams of a word of over 3 characters."""
    return [word[i : i + 3] for i in range(len(word) - 2)] if len(word) > 3 else []


def feature_counts(docs: DataFrame, column: str = "text") -> DataFrame:
    """(feature, n): words, pairs of neighbours and trigrams of all texts. Counted in Arrow batches, at most about HELD features at once in a
    task, so that counts, not occurrences, are shuffled; trigrams are counted by distinct word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[str] = Counter()
        pairs: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            found = Counter(words)
            for word, n in words.items():
                for trigram in trigrams_of(word):
                    found[trigram] += n
            for pair, n in pairs.items():
                found[pair] += n
            words.clear(), pairs.clear()
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], ["feature", "n"])

        for batch in batches:
            for text in batch.column(0):
                found = words_of(text.as_py())
                words.update(found)
                pairs.update(pairs_of(found))
                if len(words) + len(pairs) > HELD:
                    yield flush()
        yield flush()

    found = spread(docs.select(column)).mapInArrow(run, "feature string, n long")
    return dealt(found, docs, "feature").groupBy("feature").agg(F.sum("n").alias("n"))
