"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

from seatmetrics.llm.secrets import RULES


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _secrets_sql() -> str:
    parts = []
    for k, r in enumerate(RULES):
        p = _quoted(r.pattern)
        parts.append(
            f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, t.i AS i, {r.least} AS least, "
            f"coalesce(list_sum(list_transform(gaps[1:t.i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hits[1:t.i - 1], lambda x: length(x))), 0) AS s, "
            f"length(hits[t.i]) AS n, length(counted[t.i]) AS c FROM (SELECT doc_id, regexp_split_to_array(text, {p}) AS gaps, regexp_extract_all(text, {p}) AS hits, "
            f"regexp_extract_all(text, {p}, {r.group}) AS counted FROM d WHERE regexp_matches(text, {p})) x, LATERAL (SELECT unnest(range(1, len(hits) + 1)) AS i) t"
        )
    base = "','".join(("assign", "access", "hex"))
    return (
        "WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), m AS (SELECT doc_id, k, kind, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e FROM ("
        + " UNION ALL ".join(parts)
        + ") WHERE c >= least), g AS (SELECT doc_id, "
        + "".join(f"count(*) FILTER (WHERE kind = '{b}') AS n_{b}, " for b in ("assign", "access", "hex"))
        + f"string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) FILTER (WHERE kind IN ('{base}')) AS base_spans, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, k) AS spans FROM m GROUP BY doc_id) "
        "SELECT d.doc_id, "
        + "".join(f"CAST(coalesce(n_{b}, 0) AS BIGINT) AS n_{b}, " for b in ("assign", "access", "hex"))
        + "sha256(coalesce(base_spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(d.text) AS blob_id FROM d LEFT JOIN g ON d.doc_id = g.doc_id"
    )


#: Base32 by the bits of the SHA-1, five at a time.
_WARC_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, CAST(unhex(sha1(h)) AS BIT)::VARCHAR AS bits FROM p),
g AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST(
  16 * bits[5 * i + 1]::INT + 8 * bits[5 * i + 2]::INT + 4 * bits[5 * i + 3]::INT + 2 * bits[5 * i + 4]::INT + bits[5 * i + 5]::INT + 1 AS BIGINT)]), '') AS payload_digest FROM d),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM g)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
CASE WHEN page_id <> winner THEN winner END AS refers_to FROM w
"""


#: Trigram scores; a document's own occurrences are left out of every count.
_LM_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
t AS (SELECT r, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a FROM d, LATERAL (SELECT unnest(range(1, len(w) + 1)) AS i) x),
u1 AS (SELECT r, c, count(*) AS n FROM t GROUP BY ALL), u2 AS (SELECT r, b, c, count(*) AS n FROM t WHERE i > 1 GROUP BY ALL), u3 AS (SELECT r, a, b, c, count(*) AS n FROM t WHERE i > 2 GROUP BY ALL),
g1 AS (SELECT c, sum(n) AS n FROM u1 GROUP BY c), g2 AS (SELECT b, c, sum(n) AS n FROM u2 GROUP BY ALL), g3 AS (SELECT a, b, c, sum(n) AS n FROM u3 GROUP BY ALL),
s AS (SELECT t.r, t.i, least(t.i, 3) AS top, g1.n - u1.n AS c1, coalesce(g2.n - u2.n, 0) AS c2, coalesce(g3.n - u3.n, 0) AS c3, coalesce(h1.n - v1.n, 0) AS p1, coalesce(h2.n - v2.n, 0) AS p2,
  greatest((SELECT sum(n) FROM u1) - len(d.w), 1) AS every
  FROM t JOIN d USING (r) JOIN g1 ON g1.c = t.c JOIN u1 ON u1.r = t.r AND u1.c = t.c
  LEFT JOIN g2 ON g2.b = t.b AND g2.c = t.c LEFT JOIN u2 ON u2.r = t.r AND u2.b = t.b AND u2.c = t.c
  LEFT JOIN g3 ON g3.a = t.a AND g3.b = t.b AND g3.c = t.c LEFT JOIN u3 ON u3.r = t.r AND u3.a = t.a AND u3.b = t.b AND u3.c = t.c
  LEFT JOIN g1 h1 ON h1.c = t.b LEFT JOIN u1 v1 ON v1.r = t.r AND v1.c = t.b
  LEFT JOIN g2 h2 ON h2.b = t.a AND h2.c = t.b LEFT JOIN u2 v2 ON v2.r = t.r AND v2.b = t.a AND v2.c = t.b),
l AS (SELECT r, sum(CASE WHEN c3 > 0 THEN ln(c3) - ln(p2) WHEN c2 > 0 THEN (top - 2) * ln(0.4) + ln(c2) - ln(p1) ELSE (top - 1) * ln(0.4) + ln(greatest(c1, 1)) - ln(every) END) AS x FROM s GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, floor(coalesce(x, 0) * 1e4 + 0.5) / 1e4 AS log_score, floor(x / len(w) * 1e4 + 0.5) / 1e4 AS mean_log_score FROM d LEFT JOIN l USING (r)
"""


def _crc_table() -> str:
    """The table of the reflected polynomial, by its rule."""
    out = []
    for c in range(256):
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        out.append(c)
    return "[" + ", ".join(map(str, out)) + "]"


#: Unigram features in 10,000 buckets by CRC-32, floored gains, Gumbel noise by a digest of the id.
_RESAMPLE_SQL = r"""
WITH tab AS (SELECT $table AS k),
texts AS (SELECT 'd' AS o, row_number() OVER () AS r, doc_id AS id, text FROM documents UNION ALL SELECT 't', row_number() OVER (), item_id, text FROM benchmark),
split AS (SELECT o, r, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM texts),
words AS (SELECT o, r, unnest(ws) AS w FROM split),
bytes AS (SELECT w, list_transform(range(0, strlen(w)), lambda i: CAST('0x' || substr(hex(encode(w)), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)) AS b FROM (SELECT DISTINCT w FROM words)),
buckets AS (SELECT w, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], b), lambda c, x: xor(c >> 8, k[xor(c & 255, x) + 1])), 4294967295) % 10000 AS bucket FROM bytes, tab),
hits AS (SELECT o, r, bucket FROM words JOIN buckets USING (w)),
s AS (SELECT bucket, count(*) FILTER (WHERE o = 'd') AS s, count(*) FILTER (WHERE o = 't') AS t FROM hits GROUP BY bucket),
every AS (SELECT CAST(sum(s) AS DOUBLE) AS big_s, CAST(sum(t) AS DOUBLE) AS big_t FROM s),
gain AS (SELECT bucket, CAST(floor(1000 * ln((t + 1) * (big_s + 10000) / ((s + 1) * (big_t + 10000)))) AS BIGINT) AS g FROM s, every),
weight AS (SELECT r, CAST(sum(g) AS BIGINT) AS weight FROM hits JOIN gain USING (bucket) WHERE o = 'd' GROUP BY r),
scored AS (SELECT r, id AS doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
  CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(id AS VARCHAR), '')), 1, 8)) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM split LEFT JOIN weight USING (r) WHERE o = 'd'),
placed AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS k, 10 * count(*) OVER () // 100 AS drawn FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN k <= drawn THEN k END AS BIGINT) AS rank FROM scored LEFT JOIN placed USING (r)
"""


#: All anchors against all rows, exact; windows by whole numbers.
_NEGATIVES_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT * FROM v WHERE id % 50 = 0),
s AS (SELECT a.id AS anchor_id, v.id AS other, a.label = v.label AS alike, CAST(list_inner_product(a.q, v.q) AS BIGINT) AS score FROM a JOIN v ON a.id <> v.id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE alike QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, other) AS INTEGER) AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT alike AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_lm_scores": _LM_SQL,
        "op2_warc_archive": _WARC_SQL,
        "op4_secret_scans": _secrets_sql(),
        "op12_importance_resampling": _RESAMPLE_SQL.replace("$table", _crc_table()),
        "op13_hard_negatives": _NEGATIVES_SQL,
    }
