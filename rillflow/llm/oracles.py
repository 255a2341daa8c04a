"""DuckDB SQL of the training-data queries that SQL can express."""

REPEATS = r"""
WITH w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), win AS MATERIALIZED (
  SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 48, 1))) AS i FROM w)
), first AS (
  SELECT s, min(doc_id) AS m FROM win GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS j FROM win JOIN first USING (s) WHERE doc_id > m
), each AS (
  SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS j FROM w
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM each ANTI JOIN gone USING (doc_id, j) GROUP BY doc_id
)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
"""
