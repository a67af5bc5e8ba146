"""Results of operators in DuckDB's SQL, by brute force: for tables small enough to compare everything."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

LEAKS = f"""
WITH items AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL
), i AS (SELECT *, len(w) AS m, least(5, len(w)) AS k FROM items WHERE len(w) > 0
), ig AS (SELECT iid, k, list_slice(w, j, j + k - 1) AS g, count(*) AS n FROM (SELECT *, unnest(range(1, m - k + 2)) AS j FROM i) GROUP BY ALL
), d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), dg AS (SELECT rid, k, p, list_slice(w, p, p + k - 1) AS g FROM (SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(w) >= k)
), hits AS (SELECT rid, iid, p, dg.g, n FROM dg JOIN ig ON ig.k = dg.k AND ig.g = dg.g
), starts AS (SELECT DISTINCT rid, iid, s FROM (SELECT rid, iid, m, k, unnest(range(p - (m - k), p + 1)) AS s FROM hits JOIN i USING (iid)) JOIN d USING (rid) WHERE s >= 1 AND s + m - 1 <= len(w)
), common AS (SELECT rid, iid, s, sum(least(c, n)) AS c FROM (SELECT rid, iid, s, g, n, count(*) AS c FROM starts JOIN i USING (iid) JOIN hits USING (rid, iid) WHERE p BETWEEN s AND s + m - k GROUP BY ALL) GROUP BY ALL
), sim AS (SELECT rid, iid, s, CAST(c AS DOUBLE) / CAST(2 * (m - k + 1) - c AS DOUBLE) AS similarity, m, item_id FROM common JOIN i USING (iid)
), best AS (SELECT rid, doc_id, item_id, similarity, s, m FROM sim JOIN d USING (rid) WHERE similarity >= 0.8)
SELECT doc_id, item_id, similarity, CAST(s - 1 AS BIGINT) AS first_word, CAST(m AS BIGINT) AS n_words FROM best QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, s) = 1
"""

LINKS = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS (
  SELECT DISTINCT rid, g FROM (SELECT rid, unnest(list_transform(range(1, len(w) - 2), lambda p: list_slice(w, p, p + 3))) AS g FROM d WHERE len(w) >= 4 UNION ALL SELECT rid, w FROM d WHERE len(w) BETWEEN 1 AND 3)
), n AS (SELECT rid, count(*) AS n FROM g GROUP BY rid
), c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM g AS a JOIN g AS b ON a.g = b.g AND a.rid < b.rid GROUP BY ALL
), e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM c JOIN n AS na ON na.rid = c.a JOIN n AS nb ON nb.rid = c.b JOIN d AS x ON x.rid = c.a JOIN d AS y ON y.rid = c.b WHERE 100 * c >= 85 * (na.n + nb.n - c)
), edges AS (SELECT a, b FROM e UNION SELECT b, a FROM e
), reach AS (SELECT DISTINCT doc_id AS a, doc_id AS r FROM d WHERE doc_id IS NOT NULL UNION SELECT reach.a, edges.b FROM reach JOIN edges ON edges.a = reach.r
), least AS (SELECT a, min(r) AS r FROM reach GROUP BY a)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r AS component_id FROM d LEFT JOIN n USING (rid) LEFT JOIN least ON least.a = d.doc_id
"""

#: Every 50-byte string of every text, with the least doc_id that has it; runs of covered bytes by gaps and islands.
REPEATS = """
WITH b AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents
), w AS (SELECT rid, doc_id, p, b[p:p + 49] AS s FROM b, unnest(range(1, octet_length(b) - 48)) AS t(p) WHERE doc_id IS NOT NULL
), m AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (SELECT rid, p, CASE WHEN p - lag(p) OVER (PARTITION BY rid ORDER BY p) <= 50 THEN 0 ELSE 1 END AS new FROM w JOIN m USING (s) WHERE doc_id > least
), isle AS (SELECT rid, p, sum(new) OVER (PARTITION BY rid ORDER BY p) AS k FROM hit
), span AS (SELECT rid, k, min(p) AS a, max(p) + 50 AS z FROM isle GROUP BY rid, k
), gap AS (SELECT rid, a, z, lag(z, 1, 1) OVER (PARTITION BY rid ORDER BY a) AS since FROM span
), cut AS (
  SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans, string_agg(hex(CASE WHEN a > since THEN b[since:a - 1] ELSE ''::BLOB END), '' ORDER BY a) AS kept, max(z) AS upto
  FROM gap JOIN b USING (rid) GROUP BY rid
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  CASE WHEN n_spans IS NULL THEN sha256(b) ELSE sha256(unhex(kept || hex(CASE WHEN upto <= octet_length(b) THEN b[upto:octet_length(b)] ELSE ''::BLOB END))) END AS kept_sha256
FROM b LEFT JOIN cut USING (rid)
"""
