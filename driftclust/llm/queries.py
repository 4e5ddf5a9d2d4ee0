"""The queries of the text operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftclust.llm.chat import format_conversations, read_back
from driftclust.llm.common import table
from driftclust.llm.decontam import contaminations
from driftclust.llm.fertility import fertility_verdicts
from driftclust.llm.filter_audit import audit_filters
from driftclust.llm.html_text import extract_text
from driftclust.llm.importance import importance_resample
from driftclust.llm.jaccard import jaccard_components
from driftclust.llm.lines import dedup_lines
from driftclust.llm.mixing import mix_sources
from driftclust.llm.prefix_trie import prefix_trie
from driftclust.llm.ring import shard_documents
from driftclust.llm.tokens import token_counts
from driftclust.llm.toxicity import toxicity


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents without blocks of lines that an earlier document has."""
    return dedup_lines(table(spark, sf_dir, "documents")).drop("blocks")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slot of each document in a mix of sources by the roots of their bytes."""
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).drop("text")


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents whose sets of 3-word shingles have a Jaccard similarity of 0.9 or more."""
    return jaccard_components(table(spark, sf_dir, "documents"), k=3, num=90, den=100)


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards with equal counts of rows."""
    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), shards=16).drop("text")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Importance weights of all documents and which are drawn."""
    return importance_resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items found in documents."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, and of one full of control strings, read back from their formatted windows."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    return read_back(format_conversations(rows))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents."""
    return token_counts(table(spark, sf_dir, "documents"), vocabulary="word_bpe_49k.json", limit=2048)


def op10_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokeniser measures of all documents and which are kept."""
    return fertility_verdicts(table(spark, sf_dir, "documents"), vocabulary="piece_bpe_32k.model")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trie of the turns that all conversations share."""
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside of the held-out part."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters over all documents: what each does at each place of each order."""
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_line_dedup, op2_mixing, op3_ngram_jaccard, op4_html_text, op5_sharding, op6_quality, op7_decontamination, op8_chat, op9_token_counts, op10_fertility, op11_prefix_trie, op12_toxicity, op13_filter_audit)}

#: DuckDB SQL. The other operators have none: SQL can't express them, or not over whole tables; the tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op1_line_dedup": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) AS l FROM documents),
w AS (SELECT *, list_transform(l, lambda x: len(list_filter(string_split_regex(x, '[\x20\x09-\x0D]+'), lambda y: y <> ''))) AS n FROM d),
t AS (SELECT *, list_transform(range(len(l) + 1), lambda i: coalesce(list_sum(n[1:i]), 0)) AS before FROM w),
s AS (SELECT r, doc_id, l, before, unnest(range(1, len(l) + 1)) AS i FROM t WHERE text IS NOT NULL AND doc_id IS NOT NULL),
e AS (SELECT r, doc_id, l, i AS a, list_position(list_transform(before[2:], lambda x: x >= before[i] + 20), true) AS b FROM s
  UNION SELECT r, doc_id, l, len(list_filter(before[:i], lambda x: x <= before[i + 1] - 20)), i FROM s),
runs AS (SELECT r, doc_id, a, b, array_to_string(l[a:b], chr(10)) AS run FROM e WHERE a > 0 AND b > 0),
first AS (SELECT run, min(doc_id) AS first FROM runs GROUP BY run),
gone AS (SELECT DISTINCT r, unnest(range(a, b + 1)) AS i FROM runs JOIN first USING (run) WHERE doc_id > first),
g AS (SELECT r, list(i) AS gone FROM gone GROUP BY r)
SELECT doc_id, CASE WHEN gone IS NULL THEN text ELSE array_to_string(list_filter(string_split(text, chr(10)), lambda x, i: NOT list_contains(gone, i)), chr(10)) END AS text, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS n_removed
FROM d LEFT JOIN g USING (r)""",
    "op3_ngram_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) < 3 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM w),
k AS (SELECT s, min(doc_id) AS k FROM s WHERE len(s) > 0 GROUP BY s),
p AS (SELECT k, s, unnest(s[:len(s) - (90 * len(s) + 99) // 100 + 1]) AS x FROM k),
c AS (SELECT DISTINCT a.k AS a, b.k AS b FROM p a JOIN p b ON a.x = b.x AND a.k < b.k AND 100 * least(len(a.s), len(b.s)) >= 90 * greatest(len(a.s), len(b.s))),
l AS (SELECT a, b, len(list_intersect(x.s, y.s)) AS i, len(x.s) + len(y.s) AS n FROM c JOIN k x ON x.k = a JOIN k y ON y.k = b),
e AS (SELECT a, b FROM l WHERE 100 * i >= 90 * (n - i) UNION ALL SELECT b, a FROM l WHERE 100 * i >= 90 * (n - i)),
r AS (SELECT k AS a, k AS b FROM k UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
m AS (SELECT a, min(b) AS m FROM r GROUP BY a)
SELECT doc_id, len(s.s)::BIGINT AS n_shingles, coalesce(m, doc_id) AS component_id FROM s LEFT JOIN k USING (s) LEFT JOIN m ON m.a = k.k""",
    "op5_sharding": """
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS pl,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS crc FROM documents, tab),
a AS (SELECT s::INT AS shard, ('0x' || substr(md5('node:' || s || ':' || v), 1, 15))::BIGINT AS pos FROM range(16) x(s), range(64) y(v)),
arcs AS (SELECT *, row_number() OVER (ORDER BY pos, shard) - 1 AS arc FROM a),
k AS (SELECT d.*, coalesce(arc, 0) AS arc, CASE WHEN arc IS NULL THEN pl - (1::BIGINT << 60) ELSE pl END AS o FROM d ASOF LEFT JOIN arcs ON d.pl <= arcs.pos),
r AS (SELECT *, row_number() OVER (PARTITION BY arc ORDER BY o, doc_id NULLS FIRST, size, crc) - 1 AS rank FROM k),
c AS (SELECT arcs.arc, shard, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER () AS total, coalesce(sum(coalesce(n, 0)) OVER (PARTITION BY shard ORDER BY arcs.arc ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM arcs LEFT JOIN (SELECT arc, count(*) AS n FROM k GROUP BY arc) USING (arc)),
l AS (SELECT *, total // 16 + CASE WHEN shard < total % 16 THEN 1 ELSE 0 END AS load FROM c),
h AS (SELECT *, greatest(0, least(n, load - before))::BIGINT AS kept FROM l),
room AS (SELECT list(room ORDER BY shard) AS room, list(load ORDER BY shard) AS load FROM (SELECT shard, any_value(load)::BIGINT AS load, (any_value(load) - sum(kept))::BIGINT AS room FROM h GROUP BY shard)),
ov AS (SELECT h.arc, (h.n - h.kept)::BIGINT AS rest, row_number() OVER (ORDER BY h.arc) AS j FROM h WHERE h.n > h.kept),
way AS (SELECT arc, list(shard ORDER BY dist) AS o FROM (SELECT ov.arc, arcs.shard, min((arcs.arc - ov.arc + 1023) % 1024) AS dist FROM ov, arcs GROUP BY ALL) GROUP BY arc),
f AS (SELECT 0::BIGINT AS j, -1::BIGINT AS arc, room, CAST([] AS INT[]) AS o, CAST([] AS BIGINT[]) AS start, CAST([] AS BIGINT[]) AS take, room AS was FROM room
  UNION ALL
  SELECT j, arc, list_transform(range(0, 16), lambda s: was[s + 1] - take[list_position(o, s::INT)]), o, start, take, was
  FROM (SELECT *, list_transform(range(1, 17), lambda i: greatest(0, least(was[o[i] + 1], rest - start[i]))::BIGINT) AS take
    FROM (SELECT ov.j, ov.arc, ov.rest, way.o, f.room AS was, list_transform(range(1, 17), lambda i: coalesce(list_sum(list_transform(way.o[1:i - 1], lambda s: f.room[s + 1])), 0)::BIGINT) AS start FROM f JOIN ov ON ov.j = f.j + 1 JOIN way ON way.arc = ov.arc))),
p AS (SELECT arc, unnest(o) AS shard, unnest(start) AS start, unnest(take) AS take, was FROM f WHERE j > 0)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'rows' AS law, CASE WHEN rank < kept THEN h.shard ELSE p.shard END::INT AS shard,
  (CASE WHEN rank < kept THEN h.before + rank ELSE room.load[p.shard + 1] - was[p.shard + 1] + rank - kept - p.start END)::BIGINT AS slot, NULL::INT AS grown_shard
FROM r JOIN h USING (arc) CROSS JOIN room LEFT JOIN p ON p.arc = r.arc AND rank >= kept AND rank - kept >= p.start AND rank - kept < p.start + p.take""",
    "op2_mixing": """
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(strlen(text), 0) + 1 AS n_bytes, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'text:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS place FROM documents),
b AS (SELECT source, sum(n_bytes)::DOUBLE AS b FROM d GROUP BY source),
w AS (SELECT *, row_number() OVER (ORDER BY weight, source IS NOT NULL, source) AS i FROM (SELECT source, ceil(100 * sqrt(b) / sqrt(max(b) OVER ()))::BIGINT AS weight FROM b)),
p AS (SELECT sum(weight)::BIGINT AS q, list(weight ORDER BY i) AS w FROM w),
f AS (SELECT 0::BIGINT AS t, list_transform(w, lambda x: 0::BIGINT) AS k, 0::BIGINT AS pick FROM p
  UNION ALL
  SELECT t + 1, list_transform(k, lambda x, i: CASE WHEN i = best THEN x + 1 ELSE x END), best
  FROM (SELECT f.t, f.k, list_min(list_transform(f.k, lambda x, i: CASE WHEN x * p.q // p.w[i] <= f.t THEN ((x + 1) * p.q + p.w[i] - 1) // p.w[i] * 100000 + i END)) % 100000 AS best FROM f, p WHERE f.t < p.q)),
s AS (SELECT w.source, w.weight, f.t - 1 AS slot, row_number() OVER (PARTITION BY w.i ORDER BY f.t) - 1 AS j FROM f JOIN w ON f.pick = w.i),
o AS (SELECT *, coalesce(sum(n_bytes) OVER (PARTITION BY source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d)
SELECT o.doc_id, o.source, o.n_bytes, start // 65536 AS block, start % 65536 AS block_offset, (start // 65536 // s.weight) * (SELECT q FROM p) + s.slot AS slot
FROM o JOIN s ON o.source IS NOT DISTINCT FROM s.source AND s.j = (start // 65536) % s.weight""",
    "op11_prefix_trie": r"""
WITH RECURSIVE tab AS (SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab),
t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS key FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT c, key, len(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS words, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, key) AS i FROM t),
c AS (SELECT DISTINCT c, c - c % 20 AS base, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(c::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT), lambda a, b: xor(a // 256, tab[xor(a % 256, b) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) % 4 AS h FROM t, tab),
r AS (SELECT c.c, 0 AS own, i, key, words FROM c JOIN o ON o.c = c.base AND i <= h UNION ALL SELECT c.c, 1, i, key, words FROM c JOIN o ON o.c = c.c AND i > h),
d AS (SELECT c, key, words, row_number() OVER (PARTITION BY c ORDER BY own, i) AS depth FROM r),
p AS (SELECT c, depth, words, string_agg(key, '') OVER (PARTITION BY c ORDER BY depth) AS prefix FROM d UNION ALL SELECT c, 0, 0, '' FROM c),
e AS (SELECT c, max(depth) AS len FROM p GROUP BY c),
n AS (SELECT prefix, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256 FROM p JOIN e USING (c) GROUP BY ALL),
k AS (SELECT substr(prefix, 1, 32 * (depth - 1)) AS prefix, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
f AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.prefix = n.prefix),
s AS (SELECT prefix, sum((n_children = 0)::INT) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens FROM (SELECT unnest(list_transform(range(0, depth + 1), lambda j: substr(prefix, 1, 32 * j))) AS prefix, n_children, n_convs, words FROM f) GROUP BY prefix)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs::BIGINT AS n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM f JOIN s USING (prefix) LEFT JOIN n u ON u.prefix = substr(f.prefix, 1, 32 * (f.depth - 1)) AND u.depth = f.depth - 1""",
    "op13_filter_audit": r"""
WITH RECURSIVE lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM d),
f AS (SELECT w.doc_id, part, coalesce(good, false) AS good, coalesce(lab.toxic, false) AS toxic,
  (CASE WHEN len(w) < 200 THEN 1 ELSE 0 END) + (CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END)
  + (CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text) THEN 4 ELSE 0 END)
  + (CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END) + (CASE WHEN w.doc_id > first THEN 16 ELSE 0 END) AS mask FROM w LEFT JOIN lab ON lab.doc_id = w.doc_id),
g AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY ALL),
o AS (SELECT '' AS o, 0 AS used UNION ALL SELECT o || chr(65 + i::INT), used + (1 << i::INT) FROM o, range(5) r(i) WHERE used & (1 << i::INT) = 0),
steps AS (SELECT o AS filter_order, k::INT AS step, 1 << (ascii(o[k]) - 65) AS bit, list_sum(list_transform(range(1, k), lambda j: 1 << (ascii(o[j]) - 65))) AS before FROM o, range(1, 6) r(k) WHERE len(o) = 5),
c AS (SELECT part, filter_order, step, bit, sum(CASE WHEN mask & (coalesce(before, 0)::INT | bit) = 0 THEN n ELSE 0 END) AS kept,
  sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0 THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::INT > 0 THEN n ELSE 0 END) AS redundant,
  sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0 THEN n_good ELSE 0 END) AS good_lost,
  sum(CASE WHEN mask & bit > 0 AND mask & coalesce(before, 0)::INT = 0 THEN n_toxic ELSE 0 END) AS toxic_lost
  FROM g, steps GROUP BY ALL)
SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM c""",
}
