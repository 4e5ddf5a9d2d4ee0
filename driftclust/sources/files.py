"""Items from CSV, TSV and JSON lines files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftclust.config import Columns
from driftclust.state.files import Files


class InputError(ValueError):
    """A file that isn't what it should be."""


SUFFIXES = {".csv": ",", ".tsv": "\t", ".jsonl": None, ".ndjson": None}


def parse_timestamp(value: Column) -> Column:
    """A time from ISO 8601 text (no zone means UTC), or from seconds since 1970 as a number or text; null if it is neither."""
    text = F.trim(value.cast("string"))
    seconds = text.try_cast("double")
    return F.coalesce(F.timestamp_micros((seconds * 1_000_000).cast("long")), F.try_to_timestamp(text))


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """Rows of strings, columns as in the file; for JSON lines, objects as maps."""
    lowered = path.lower()
    suffix = next((s for s in SUFFIXES if lowered.endswith(s)), None)
    if suffix is None:
        raise InputError(f"{path}: unknown kind of file; known: {', '.join(SUFFIXES)}")
    folder, _, name = path.rpartition("/")
    if name not in Files(spark, folder or ".").names(""):
        raise FileNotFoundError(path)
    if SUFFIXES[suffix] is not None:
        rows = spark.read.option("header", True).option("sep", SUFFIXES[suffix]).option("multiLine", True).option("escape", '"').csv(path)
        return rows.toDF(*(c.removeprefix("﻿") for c in rows.columns))
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("line")).where("trim(line) <> ''")
    parsed = lines.select("line", F.from_json("line", "map<string,string>", {"mode": "PERMISSIVE"}).alias("fields"))
    bad = parsed.where("fields is null or not startswith(trim(line), '{') or cardinality(fields) = 0 and trim(line) not rlike '^\\\\{\\\\s*\\\\}$'").limit(1).collect()
    if bad:
        raise InputError(f"{path}: not a JSON object: {bad[0].line[:80]}")
    return parsed.select("fields")


def read_items(spark: SparkSession, path: str, columns: Columns | None = None) -> DataFrame:
    """(id, text, ts, metadata, label) from a file; columns by their configured names, all others that aren't empty as metadata.

    Raises FileNotFoundError, or InputError with the first row that lacks an id, a text or a time.
    """
    names = columns or Columns()
    raw = _raw(spark, path)
    if raw.columns == ["fields"]:
        get = lambda c: F.try_element_at(F.col("fields"), F.lit(c))
        fields = F.col("fields")
    else:
        missing = {names.id, names.text, names.timestamp} - set(raw.columns)
        if missing:
            raise InputError(f"{path}: no column {', '.join(sorted(missing))}")
        get = lambda c: F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")
        fields = F.map_from_arrays(F.array(*(F.lit(c) for c in raw.columns)), F.array(*(F.col(f"`{c}`") for c in raw.columns)))
    known = F.array(*(F.lit(c) for c in (names.id, names.text, names.timestamp, names.label)))
    rest = F.map_filter(fields, lambda k, v: ~F.array_contains(known, k) & v.isNotNull() & (F.trim(v) != ""))
    label = F.trim(get(names.label))
    rows = raw.select(F.trim(get(names.id)).alias("id"), F.trim(get(names.text)).alias("text"), parse_timestamp(get(names.timestamp)).alias("ts"), rest.alias("metadata"), F.when(label != "", label).alias("label"))
    bad = rows.where("id is null or id = '' or text is null or text = '' or ts is null").limit(1).collect()
    if bad:
        raise InputError(f"{path}: a row without id, text or time: {bad[0].asDict()}")
    return rows


def write_items(items: DataFrame, path: str) -> None:
    """A CSV folder with id, text, timestamp and label."""
    label = F.col("label") if "label" in items.columns else F.lit(None).cast("string")
    items.select("id", "text", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("timestamp"), label.alias("label")).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
