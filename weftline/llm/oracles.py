"""DuckDB SQL for the queries that SQL can express, over whole tables and texts."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"'[^\x20\x09-\x0D]+'"

JACCARD_JOIN = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_WORDS}) AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS p, b.doc_id AS q, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT p, q FROM shared JOIN n a ON a.doc_id = p JOIN n b ON b.doc_id = q WHERE 100 * k >= 80 * (a.n + b.n - k)),
edges AS (SELECT p, q FROM links UNION ALL SELECT q, p FROM links),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, q FROM reach JOIN edges ON r = p)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.r AS component_id FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS r FROM reach GROUP BY doc_id) c USING (doc_id)"""

SUBSTRING_DEDUP = rf"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, i, ws[i:i + 19] AS x FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS k FROM later),
each AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS k, unnest(ws) AS x FROM w),
kept AS (SELECT e.doc_id, string_agg(x, ' ' ORDER BY e.k) FILTER (WHERE g.k IS NULL) AS t, count(g.k) AS r FROM each e LEFT JOIN gone g ON g.doc_id = e.doc_id AND g.k = e.k GROUP BY e.doc_id)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(r, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)"""

SUFFIX_DEDUP = """WITH h AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 200)) AS x FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS i FROM h WHERE length(h) >= 200)),
later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
stepped AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS fresh FROM later),
runs AS (SELECT doc_id, min(i) AS b, max(i) + 100 AS e FROM (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM stepped) GROUP BY doc_id, g),
parts AS (SELECT doc_id, b, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS p FROM runs),
kept AS (SELECT doc_id, count(*) AS n, sum(e - b) AS gone, max(e) AS last, string_agg(substr(h, 2 * p + 1, 2 * (b - p)), '' ORDER BY b) AS t FROM parts JOIN h USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(n, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(t || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM h LEFT JOIN kept USING (doc_id)"""

_TEST_WORDS = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"
DECONTAMINATION = rf"""WITH b AS (SELECT item_id, regexp_extract_all({_LOWER}, {_TEST_WORDS}) AS ws FROM benchmark),
pat AS (SELECT DISTINCT item_id, ws[i:i + 9] AS x FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT len(x) AS k FROM pat),
d AS (SELECT doc_id, regexp_extract_all({_LOWER}, {_TEST_WORDS}) AS ws FROM documents),
win AS (SELECT doc_id, k, i, ws[i:i + k - 1] AS x FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM d, lens WHERE len(ws) >= k)),
met AS (SELECT doc_id, i, k, item_id FROM win JOIN pat USING (x)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM met) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM met) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)"""

ORACLE_SQL = {"op3_jaccard_join": JACCARD_JOIN, "op5_substring_dedup": SUBSTRING_DEDUP, "op6_suffix_dedup": SUFFIX_DEDUP, "op10_decontamination": DECONTAMINATION}
