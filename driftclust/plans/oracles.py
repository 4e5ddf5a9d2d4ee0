"""The catalogue's queries as DuckDB SQL over the same tables. q26, q28 and q51 (BLAKE2b, a fold over labels, density groups) have none."""

from __future__ import annotations

_MEMBERS = "m AS (SELECT label::VARCHAR AS cluster_id, vec_id::VARCHAR AS item_id, vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
_EXEMPLARS = (
    _MEMBERS
    + """,
x0 AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('42:' || cluster_id || ':' || item_id), item_id) AS r FROM m),
x AS (SELECT cluster_id, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) - 1 AS pos, item_id, e FROM x0 WHERE r <= 8)"""
)
_SCORES = (
    _EXEMPLARS
    + """,
s0 AS (SELECT m.cluster_id, m.item_id, list_reverse_sort(list(list_dot_product(m.e, x.e))) AS sims FROM m JOIN x ON m.cluster_id = x.cluster_id AND m.item_id <> x.item_id GROUP BY ALL),
s1 AS (SELECT m.cluster_id, m.item_id, coalesce(sims, []) AS sims FROM m LEFT JOIN s0 USING (cluster_id, item_id)),
s2 AS (SELECT *, greatest(1, least(5, min(len(sims)) OVER (PARTITION BY cluster_id))) AS k FROM s1),
s AS (SELECT cluster_id, item_id, coalesce(list_avg(sims[1:k]), 0) AS score FROM s2)"""
)
_LIMITS = (
    _SCORES
    + """,
t0 AS (SELECT cluster_id, quantile_cont(score, 0.05) AS cohesion FROM s GROUP BY ALL),
t AS (SELECT cluster_id, cohesion, least(greatest(cohesion, 0.15), 0.90) AS threshold FROM t0)"""
)
_ALL = "a AS (SELECT m.item_id, m.vec_id, x.cluster_id, list_avg((list_reverse_sort(list(list_dot_product(m.e, x.e))))[1:5]) AS score FROM m, x GROUP BY ALL)"
_DECIDE = """
d0 AS (SELECT a.item_id, a.cluster_id, a.score, t.threshold, row_number() OVER (PARTITION BY a.item_id ORDER BY a.score DESC, a.cluster_id) AS r FROM a JOIN t USING (cluster_id)),
d AS (SELECT item_id, max(CASE WHEN r = 1 AND score >= threshold THEN cluster_id END) AS cluster_id, round(max(CASE WHEN r = 1 THEN score END), 6) AS score,
  max(CASE WHEN r = 2 THEN cluster_id END) AS runner_up_cluster_id, round(max(CASE WHEN r = 2 THEN score END), 6) AS runner_up_score FROM d0 GROUP BY ALL)"""
_SIMILAR = (
    _EXEMPLARS
    + """,
one AS (SELECT p.cluster_id AS a, p.item_id, q.cluster_id AS b, list_avg((list_reverse_sort(list(list_dot_product(p.e, q.e))))[1:5]) AS best FROM x p JOIN x q ON p.cluster_id <> q.cluster_id GROUP BY ALL),
way AS (SELECT a, b, avg(best) AS w FROM one GROUP BY ALL),
sim AS (SELECT f.a, f.b, (f.w + g.w) / 2 AS similarity FROM way f JOIN way g ON f.a = g.b AND f.b = g.a WHERE f.a < f.b)"""
)
_CENTROIDS = """
c0 AS (SELECT cluster_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS v FROM m),
c1 AS (SELECT cluster_id, i, avg(v) AS v FROM c0 GROUP BY ALL),
c2 AS (SELECT *, greatest(sqrt(sum(v * v) OVER (PARTITION BY cluster_id)), 1e-12) AS n FROM c1),
c AS (SELECT cluster_id, list(v / n ORDER BY i) AS centroid FROM c2 GROUP BY ALL)"""
_NOW = "now AS (SELECT date_trunc('day', max(ts)) + INTERVAL 1 DAY AS t FROM events)"
_USERS = "u AS (SELECT user_id::VARCHAR AS id, count(*) AS size, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY ALL)"
_SESSIONS = """
e0 AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 1 DAY THEN 0 ELSE 1 END AS fresh FROM events),
e1 AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS nth FROM e0),
se AS (SELECT user_id, nth, min(ts) AS "start", max(ts) AS "end", count(*) AS n FROM e1 GROUP BY ALL)"""
_LOG = (
    _SESSIONS
    + """,
lg AS (SELECT user_id::VARCHAR AS cluster_id, CASE WHEN nth = 1 THEN 'cluster.opened' ELSE 'cluster.reopened' END AS type, "start" AS ts, nth * 2 AS seq FROM se
  UNION ALL SELECT user_id::VARCHAR, 'cluster.closed', "end", nth * 2 + 1 FROM se WHERE n > 1)"""
)
_JUDGED = "j AS (SELECT source AS cluster_id, CASE WHEN lang = 'es' THEN 'noise' ELSE lang END AS label, CASE WHEN n_chars % 7 = 0 THEN 'buffered' ELSE 'assigned' END AS status FROM documents)"
_COUNTS = _JUDGED + ", tc AS (SELECT cluster_id, label, count(*) AS n FROM j WHERE status = 'assigned' AND cluster_id IS NOT NULL AND label IS NOT NULL GROUP BY ALL)"
_MAJOR = _COUNTS + ", mj AS (SELECT cluster_id, first(label ORDER BY n DESC, label) AS majority, max(n) AS n, sum(n)::BIGINT AS total FROM tc GROUP BY ALL)"
_MIXED = """
tp AS (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, label) AS r, sum(n) OVER (PARTITION BY cluster_id) AS total FROM tc WHERE label <> 'noise'),
mx AS (SELECT k.cluster_id, coalesce(tp.n / tp.total, 0.0) AS second_share, coalesce(tp.n / tp.total >= 0.12, false) AS mixed FROM (SELECT DISTINCT cluster_id FROM tc) k LEFT JOIN tp ON tp.cluster_id = k.cluster_id AND tp.r = 2)"""
_FEATURES = """
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents),
f0 AS (SELECT doc_id, unnest(w) AS feature FROM w
  UNION ALL SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i + 1])) FROM w
  UNION ALL SELECT doc_id, unnest(flatten(list_transform(list_filter(w, lambda x: len(x) > 3), lambda x: list_transform(range(1, len(x) - 1), lambda i: x[i:i + 2])))) FROM w)"""


def _hashed(dim: int) -> str:
    return f"""h{dim} AS (SELECT doc_id, (v // 2) % {dim} AS slot, CASE WHEN v % 2 = 1 THEN 1 ELSE -1 END AS s FROM (SELECT doc_id, ('0x' || substr(md5(feature), 1, 15))::BIGINT AS v FROM f0)),
z{dim} AS (SELECT doc_id, slot, sum(s)::BIGINT AS value FROM h{dim} GROUP BY ALL HAVING sum(s) <> 0)"""


def _buckets(key: str, width: str) -> str:
    return f"""
b0 AS (SELECT {key}, epoch_us(ts) AS t FROM events),
b1 AS (SELECT {key}, min(t) AS lo, max(t) AS hi FROM b0 GROUP BY ALL),
b2 AS (SELECT *, {width} AS width FROM b1),
b3 AS (SELECT *, lo - lo % (CASE WHEN width >= 86400000000 THEN 86400000000 ELSE 3600000000 END) AS origin FROM b2),
b4 AS (SELECT {key}, origin, width, unnest(range(0, (hi - origin) // width + 1)) AS i FROM b3),
b5 AS (SELECT {key}, (t - origin) // width AS i, count(*) AS n FROM b0 JOIN b3 USING ({key}) GROUP BY ALL),
bk AS (SELECT {key}, make_timestamp(origin + i * width) AS bucket_start, coalesce(n, 0) AS n FROM b4 LEFT JOIN b5 USING ({key}, i))"""


_AUTO = _buckets("user_id", "CASE WHEN hi - lo < 172800000000 THEN 3600000000 ELSE 86400000000 END")
_RANKED = "rk AS (SELECT user_id AS cluster_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events)"
_CENTRAL = "ce AS (SELECT m.cluster_id, m.item_id, m.vec_id, row_number() OVER (PARTITION BY m.cluster_id ORDER BY round(list_dot_product(m.e, c.centroid), 9) DESC, m.vec_id) AS rank FROM m JOIN c USING (cluster_id))"
_RANDOM = """
r0 AS (SELECT cluster_id, item_id, row_number() OVER (PARTITION BY cluster_id ORDER BY md5('42:' || cluster_id || ':' || item_id), item_id) AS r FROM m)"""


def _sql() -> dict[str, str]:
    from driftclust.functions.terms import STOP_WORDS

    stop = ", ".join(f"'{w}'" for w in STOP_WORDS)
    words = rf"""
g AS (SELECT source, unnest(list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains([{stop}], x))) AS term FROM documents),
g1 AS (SELECT source, term, count(*) AS n FROM g GROUP BY ALL),
g2 AS (SELECT source, sum(n) AS sn FROM g1 GROUP BY ALL),
g3 AS (SELECT term, sum(n) AS tn FROM g1 GROUP BY ALL),
g4 AS (SELECT source, term, round(n / sn * ln(1 + (SELECT sum(sn) / count(*) FROM g2) / tn), 9) AS score FROM g1 JOIN g2 USING (source) JOIN g3 USING (term))"""
    red = "text"
    for pattern, token in (
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"),
        (r"\b(?:\d[ -]?){13,19}\b", "[CARD]"),
        (r"\b\d{3}-\d{2}-\d{4}\b", "[SSN]"),
        (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
        (r"(^|[^\w])\+?\d{1,3}?[ .-]?\(?\d{3}\)?[ .-]?\d{3}[ .-]?\d{4}\b", r"\1[PHONE]"),
        (r"https?://\S+", "[URL]"),
    ):
        red = f"regexp_replace({red}, '{pattern}', '{token}', 'g')"
    count = lambda t: f"((length(r) - length(replace(r, '[{t}]', ''))) // {len(t) + 2})::BIGINT AS {t.lower()}"
    return {
        "q01_centroid_cosine": f"WITH {_MEMBERS}, {_CENTROIDS} SELECT vec_id, round(list_dot_product(e, centroid), 6) AS cosine, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM m JOIN c USING (cluster_id)",
        "q02_topk_mean": f"WITH {_EXEMPLARS}, {_ALL} SELECT vec_id, cluster_id, round(score, 6) AS score FROM a",
        "q03_exemplars": f"WITH {_EXEMPLARS} SELECT cluster_id, pos, item_id FROM x",
        "q04_member_scores": f"WITH {_SCORES} SELECT cluster_id, item_id, round(score, 6) AS score FROM s",
        "q05_cluster_threshold": f"WITH {_LIMITS} SELECT cluster_id, round(cohesion, 6) AS cohesion, round(threshold, 6) AS threshold FROM t",
        "q06_cohesion_gate": f"WITH {_LIMITS} SELECT cluster_id, CASE WHEN cohesion < 0.15 THEN 'rejected' ELSE 'opened' END AS verdict FROM t",
        "q07_assign_batch": f"WITH {_LIMITS}, {_ALL}, {_DECIDE} SELECT * FROM d",
        "q08_assign_nearest": f"""WITH {_LIMITS},
n0 AS (SELECT m.item_id, x.cluster_id, x.pos, list_dot_product(m.e, x.e) AS sim FROM m, x),
n1 AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY sim DESC, cluster_id, pos) AS r FROM n0),
n2 AS (SELECT item_id, cluster_id, (list_reverse_sort(list(sim)))[1:5] AS sims FROM n1 WHERE r <= 20 GROUP BY ALL),
h AS (SELECT cluster_id, count(*) AS have FROM x GROUP BY ALL),
a AS (SELECT item_id, cluster_id, list_sum(sims) / least(5, have) AS score FROM n2 JOIN h USING (cluster_id)), {_DECIDE} SELECT * FROM d""",
        "q09_set_similarity": f"WITH {_SIMILAR} SELECT a, b, round(similarity, 6) AS similarity FROM sim",
        "q63_stream_closings": """WITH e AS (SELECT event_type, user_id, ts, lead(ts) OVER w AS nxt, row_number() OVER w AS size FROM events WINDOW w AS (PARTITION BY event_type, user_id ORDER BY ts))
SELECT event_type AS stream_key, user_id::VARCHAR AS cluster_id, ts + INTERVAL 1 DAY AS "at", size::BIGINT AS size FROM e WHERE nxt - ts >= INTERVAL 1 DAY OR nxt IS NULL AND ts + INTERVAL 1 DAY <= (SELECT max(ts) FROM events)""",
        "q64_stream_orphans": """SELECT event_type AS stream_key, event_id::VARCHAR AS item_id, ts AS "at" FROM events WHERE event_type <> 'purchase' AND ts < (SELECT max(ts) FROM events) - INTERVAL 21 DAY""",
        "q62_vector_memory": "SELECT count(*) AS n, count(DISTINCT coalesce(text, '')) AS n_distinct, count(*) AS n_vectors, count(DISTINCT coalesce(text, '')) AS remembered FROM documents",
        "q59_nearest_exact": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0),
s AS (SELECT a.vec_id, b.vec_id AS nearest, list_dot_product(a.e, b.e) AS sim FROM u a, u b WHERE a.vec_id % 50 = 0)
SELECT vec_id, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, nearest) AS rank, nearest, round(sim, 6) AS sim FROM s QUALIFY rank <= 10""",
        "q61_similar_vectors": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM v WHERE list_dot_product(e, e) > 0)
SELECT a.vec_id AS a, b.vec_id AS b, round(list_dot_product(a.e, b.e), 6) AS cosine FROM u a JOIN u b ON a.vec_id < b.vec_id WHERE list_dot_product(a.e, b.e) >= 0.3""",
        "q10_merge_candidates": f"""WITH {_SIMILAR}, cm AS (SELECT cluster_id, unnest(range(1, len(e) + 1)) AS i, unnest(e) AS v FROM x), c1 AS (SELECT cluster_id, i, avg(v) AS v FROM cm GROUP BY ALL),
c2 AS (SELECT *, greatest(sqrt(sum(v * v) OVER (PARTITION BY cluster_id)), 1e-12) AS n FROM c1), c AS (SELECT cluster_id, list(v / n ORDER BY i) AS centroid FROM c2 GROUP BY ALL)
SELECT a, b, round(similarity, 6) AS similarity FROM sim JOIN c ca ON ca.cluster_id = a JOIN c cb ON cb.cluster_id = b
WHERE list_dot_product(ca.centroid, cb.centroid) >= 0.08 - 0.15 AND b::INT - a::INT <> 1 AND similarity >= 0.08""",
        "q11_survivors": """WITH z AS (SELECT label::VARCHAR AS id, count(*) AS size, min(vec_id) AS opened_at FROM embeddings GROUP BY ALL)
SELECT a.id AS a, b.id AS b, CASE WHEN (-a.size, a.opened_at, a.id) < (-b.size, b.opened_at, b.id) THEN a.id ELSE b.id END AS survivor,
CASE WHEN (-a.size, a.opened_at, a.id) < (-b.size, b.opened_at, b.id) THEN b.id ELSE a.id END AS absorbed FROM z a JOIN z b ON a.id < b.id""",
        "q12_centroids": f"WITH {_MEMBERS}, {_CENTROIDS} SELECT cluster_id, i - 1 AS dim, round(v / n, 6) AS x FROM c2",
        "q13_central_sample": f"WITH {_MEMBERS}, {_CENTROIDS}, {_CENTRAL} SELECT cluster_id, item_id, rank FROM ce WHERE rank <= 5",
        "q14_recent_sample": f"WITH {_RANKED} SELECT * FROM rk WHERE rank <= 5",
        "q15_random_sample": f"WITH {_MEMBERS}, {_RANDOM} SELECT cluster_id, item_id, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) AS rank FROM r0 WHERE r <= 5",
        "q16_mixed_sample": f"""WITH {_MEMBERS}, {_CENTROIDS}, {_CENTRAL}, {_RANDOM},
p AS (SELECT cluster_id, item_id, 0 AS part, rank FROM ce WHERE rank <= 3
  UNION ALL SELECT cluster_id, item_id, 1, r FROM (SELECT *, row_number() OVER (PARTITION BY cluster_id ORDER BY vec_id) AS r FROM m) WHERE r <= 3
  UNION ALL SELECT cluster_id, item_id, 2, row_number() OVER (PARTITION BY cluster_id ORDER BY item_id) FROM r0 WHERE r <= 9),
o AS (SELECT *, row_number() OVER (PARTITION BY cluster_id, item_id ORDER BY part, rank) AS once FROM p)
SELECT cluster_id, item_id, row_number() OVER (PARTITION BY cluster_id ORDER BY part, rank) AS rank FROM o WHERE once = 1 QUALIFY rank <= 9""".replace("QUALIFY rank <= 9", "QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY part, rank) <= 9"),
        "q17_counts_hourly": f"WITH {_buckets('event_type', '3600000000')} SELECT * FROM bk",
        "q18_counts_auto": f"WITH {_AUTO} SELECT * FROM bk",
        "q19_dedupe_first": "SELECT md5(text) AS text_md5, min(doc_id) AS doc_id FROM documents GROUP BY ALL",
        "q20_unknown_items": "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "q21_number_items": "SELECT doc_id, row_number() OVER (ORDER BY doc_id) + (SELECT count(DISTINCT doc_id) FROM labels) AS seq FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
        "q22_normalize": r"WITH n AS (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) SELECT doc_id, md5(t) AS text_md5, length(t) AS n_chars, md5(left(t, 400)) AS short_md5 FROM n",
        "q23_redact": f"WITH z AS (SELECT doc_id, {red} AS r FROM documents) SELECT doc_id, {', '.join(map(count, ('EMAIL', 'CARD', 'SSN', 'IP', 'PHONE', 'URL')))}, md5(regexp_replace(r, '\\s+', '', 'g')) AS text_md5 FROM z",
        "q24_features": f"WITH {_FEATURES} SELECT feature, count(*) AS n FROM f0 GROUP BY ALL",
        "q25_embed_md5": f"WITH {_FEATURES}, {_hashed(256)} SELECT * FROM z256",
        "q27_ctfidf_terms": f"WITH {words}, g5 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, term) AS rank FROM g4 WHERE score > 0) SELECT source, term, round(score, 6) AS score, rank FROM g5 WHERE rank <= 5",
        "q28_ctfidf_labels": rf"""
WITH RECURSIVE w AS (SELECT source, doc_id, list_filter(regexp_extract_all(lower(text), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}'), lambda x: NOT list_contains([{stop}], x)) AS w FROM documents),
e AS (SELECT source, w, lag(w[-1]) OVER (PARTITION BY source ORDER BY doc_id) AS b FROM w WHERE len(w) > 0),
g AS (SELECT source, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) || CASE WHEN b IS NULL THEN [] ELSE [b || ' ' || w[1]] END) AS term FROM e),
g1 AS (SELECT source, term, count(*) AS n FROM g GROUP BY ALL),
g2 AS (SELECT source, sum(n) AS sn FROM g1 GROUP BY ALL),
g3 AS (SELECT term, sum(n) AS tn FROM g1 GROUP BY ALL),
g4 AS (SELECT source, term, n / sn * ln(1 + (SELECT sum(sn) / count(*) FROM g2) / tn) AS score FROM g1 JOIN g2 USING (source) JOIN g3 USING (term)),
l AS (SELECT source, list(term ORDER BY round(score, 12) DESC, term) AS l FROM g4 WHERE score > 0 GROUP BY source),
f AS (SELECT source, l, CAST([] AS VARCHAR[]) AS kept FROM l
  UNION ALL SELECT source, list_filter(l[2:], lambda t: NOT (contains(t, l[1]) OR contains(l[1], t))), kept || [l[1]] FROM f WHERE len(l) > 0 AND len(kept) < 5)
SELECT source, array_to_string(arg_max(kept, len(kept)), ' · ') AS label FROM f GROUP BY source""",
        "q29_cluster_id": "SELECT label::VARCHAR AS label, 'cl_' || substr(sha256(string_agg(vec_id::VARCHAR, chr(10) ORDER BY vec_id::VARCHAR)), 1, 12) AS id FROM embeddings GROUP BY label",
        "q30_attach": """WITH b AS (SELECT user_id::VARCHAR AS id, count(*) AS size, min(ts) AS f, max(ts) AS l FROM events WHERE event_type <> 'purchase' GROUP BY ALL),
p AS (SELECT user_id::VARCHAR AS id, count(*) AS n, min(ts) AS f, max(ts) AS l FROM events WHERE event_type = 'purchase' GROUP BY ALL)
SELECT id, CASE WHEN n IS NULL THEN 'closed' ELSE 'open' END AS status, size + coalesce(n, 0) AS size, size + coalesce(n, 0) AS seen_count, least(b.f, coalesce(p.f, b.f)) AS first_seen, greatest(b.l, coalesce(p.l, b.l)) AS last_seen,
CASE WHEN n IS NULL THEN b.l END AS closed_at FROM b LEFT JOIN p USING (id)""",
        "q31_close_quiet": f"""WITH {_NOW}, {_USERS}, rc AS (SELECT user_id::VARCHAR AS id, count(*) AS n FROM events, now WHERE ts > t - INTERVAL 1 DAY GROUP BY ALL)
SELECT id, 3::BIGINT AS floor FROM u LEFT JOIN rc USING (id) WHERE coalesce(n, 0) < 3 UNION ALL SELECT id, 1 FROM u, now WHERE last_seen <= t - INTERVAL 1 DAY""",
        "q32_archive_expired": f"WITH {_NOW}, {_USERS} SELECT id, 'now' AS at FROM u, now WHERE last_seen + INTERVAL 1 DAY < t - INTERVAL 2 DAY UNION ALL SELECT id, 'later' FROM u, now WHERE last_seen + INTERVAL 1 DAY < t",
        "q33_matchable": f"WITH {_NOW}, {_USERS} SELECT id, CASE WHEN size % 2 = 0 THEN 'open' ELSE 'closed' END AS status FROM u, now WHERE size % 2 = 0 OR (size % 5 <> 0 AND last_seen + INTERVAL 1 DAY >= t - INTERVAL 2 DAY)",
        "q34_orphan_stale": f"WITH {_NOW} SELECT event_id FROM events, now WHERE event_type <> 'purchase' AND ts < t - INTERVAL 21 DAY",
        "q35_relabel_due": "SELECT user_id::VARCHAR AS id, count(*) AS size, count(*) FILTER (event_type <> 'view') AS label_size FROM events GROUP BY ALL HAVING count(*) >= greatest(1, count(*) FILTER (event_type <> 'view')) * 1.25",
        "q36_sessions": f'WITH {_SESSIONS} SELECT user_id, "start", "end", n FROM se',
        "q37_open_segments": f"""WITH {_LOG}, k AS (SELECT *, (type = 'cluster.closed')::INT AS is_end FROM lg),
i AS (SELECT *, coalesce(sum(is_end) OVER (PARTITION BY cluster_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM k),
q AS (SELECT cluster_id, island, min(ts) FILTER (is_end = 0) AS "start", max(ts) FILTER (is_end = 1) AS "end" FROM i GROUP BY ALL)
SELECT cluster_id, "start", coalesce("end", (SELECT max(ts) FROM lg)) AS "end", "end" IS NULL AS open_at_end FROM q WHERE "start" IS NOT NULL""",
        "q38_resolve_chain": """WITH RECURSIVE r AS (SELECT c_custkey AS id, c_custkey AS to_id, 0::BIGINT AS hops FROM customer UNION ALL SELECT id, to_id // 2, hops + 1 FROM r WHERE to_id > 1)
SELECT id, to_id::BIGINT AS final, hops FROM r WHERE to_id <= 1""",
        "q39_majority": f"WITH {_MAJOR} SELECT * FROM mj",
        "q40_mixed_clusters": f"WITH {_COUNTS}, {_MIXED} SELECT cluster_id, round(second_share, 6) AS second_share, mixed FROM mx",
        "q41_quality": f"""WITH {_MAJOR}, {_MIXED} SELECT (SELECT round(sum(n) / sum(total), 4) FROM mj) AS precision, (SELECT count(*) FROM mj) AS clusters,
(SELECT round(count(*) / count(DISTINCT majority), 3) FROM mj WHERE majority <> 'noise') AS fragmentation, (SELECT round(avg(mixed::INT), 4) FROM mx) AS false_merge_rate,
(SELECT round(avg((status <> 'assigned')::INT), 4) FROM j) AS orphan_rate, (SELECT round(avg((status <> 'assigned')::INT), 4) FROM j WHERE label <> 'noise') AS topic_orphan_rate""",
        "q44_time_to_detect": """WITH p AS (SELECT user_id, min(ts) AS f, min(ts) FILTER (event_type = 'purchase') AS g FROM events GROUP BY ALL)
SELECT round(median((epoch_us(g) - epoch_us(f)) / 3600000000), 2) AS median_hours, count(*) AS users FROM p WHERE g IS NOT NULL""",
        "q45_close_lag": f"""WITH {_LOG}, f AS (SELECT cluster_id, arg_max(type, seq) AS type, arg_max(ts, seq) + INTERVAL 1 DAY AS closed_at FROM lg WHERE type <> 'cluster.opened' GROUP BY ALL),
l AS (SELECT user_id::VARCHAR AS cluster_id, max(ts) AS last FROM events GROUP BY ALL)
SELECT round(median((epoch_us(closed_at) - epoch_us(last)) / 3600000000), 2) AS median_hours, count(*) AS users FROM f JOIN l USING (cluster_id) WHERE type = 'cluster.closed'""",
        "q46_status_counts": "SELECT event_type, coalesce(n, 0) AS n FROM (SELECT unnest(['click', 'view', 'purchase', 'signup', 'logout', 'refund']) AS event_type) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY ALL) USING (event_type)",
        "q47_pareto_front": """WITH p AS (SELECT p_partkey, p_size::BIGINT AS p_size, p_retailprice::DOUBLE AS p_retailprice FROM part)
SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM p q WHERE q.p_size <= p.p_size AND q.p_retailprice <= p.p_retailprice AND (q.p_size < p.p_size OR q.p_retailprice < p.p_retailprice))""",
        "q48_percentiles": "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY ALL",
        "q49_event_log": f"""WITH {_LIMITS}, {_ALL}, {_DECIDE} SELECT 100 + row_number() OVER (ORDER BY item_id::BIGINT) AS seq, 'item.assigned' AS type, cluster_id, item_id,
'{{"score":' || trunc(score * 1000)::BIGINT || '}}' AS data FROM d WHERE cluster_id IS NOT NULL""",
        "q50_make_batches": """WITH RECURSIVE o AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
f AS (SELECT user_id, rn, ts, ts AS s, 1 AS size, 0::BIGINT AS batch FROM o WHERE rn = 1
  UNION ALL SELECT o.user_id, o.rn, o.ts, CASE WHEN o.ts - f.s >= INTERVAL 36 HOUR OR f.size >= 5 THEN o.ts ELSE f.s END, CASE WHEN o.ts - f.s >= INTERVAL 36 HOUR OR f.size >= 5 THEN 1 ELSE f.size + 1 END,
  CASE WHEN o.ts - f.s >= INTERVAL 36 HOUR OR f.size >= 5 THEN f.batch + 1 ELSE f.batch END FROM f JOIN o ON o.user_id = f.user_id AND o.rn = f.rn + 1)
SELECT user_id, batch, count(*) AS n, min(ts) AS "start", max(ts) AS "end" FROM f GROUP BY user_id, batch""",
        "q52_merge_greedy": f"""WITH RECURSIVE {_SIMILAR}, o AS (SELECT a, b, round(similarity, 6) AS similarity, row_number() OVER (ORDER BY round(similarity, 6) DESC, a, b) AS rn FROM sim WHERE round(similarity, 6) >= 0.1),
f AS (SELECT 0::BIGINT AS rn, []::VARCHAR[] AS taken, NULL::VARCHAR AS a, NULL::VARCHAR AS b, NULL::DOUBLE AS similarity
  UNION ALL SELECT o.rn, CASE WHEN list_contains(f.taken, o.a) OR list_contains(f.taken, o.b) THEN f.taken ELSE list_concat(f.taken, [o.a, o.b]) END,
  CASE WHEN list_contains(f.taken, o.a) OR list_contains(f.taken, o.b) THEN NULL ELSE o.a END, CASE WHEN list_contains(f.taken, o.a) OR list_contains(f.taken, o.b) THEN NULL ELSE o.b END, o.similarity FROM f JOIN o ON o.rn = f.rn + 1)
SELECT a, b, similarity FROM f WHERE a IS NOT NULL""",
        "q53_stream_counts": "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS \"start\", count(*) AS n FROM events GROUP BY ALL",
        "q54_stream_dedup": "SELECT DISTINCT user_id, event_type FROM events",
        "q55_stream_sessions": f'WITH {_SESSIONS} SELECT user_id, "start", "end", n FROM se',
        "q57_cluster_detail": f"WITH {_RANKED}, {_AUTO}, dy AS (SELECT user_id, count(*) AS buckets, sum(n)::BIGINT AS n, max(n) AS most FROM bk GROUP BY ALL) SELECT user_id, event_id AS newest, buckets, n, most FROM rk JOIN dy ON dy.user_id = rk.cluster_id WHERE rank = 1",
        "q58_reembed": f"WITH {_FEATURES}, {_hashed(256)}, {_hashed(128)}, a AS (SELECT doc_id, count(*) AS nonzero_256 FROM z256 GROUP BY ALL), b AS (SELECT doc_id, count(*) AS nonzero_128 FROM z128 GROUP BY ALL) SELECT * FROM a JOIN b USING (doc_id)",
    }


ORACLES: dict[str, str] = _sql()
