"""DuckDB statements for the queries that SQL can express."""

from __future__ import annotations

OP1 = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages
), f AS (SELECT d, min(page_id) AS first_id FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, p.n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN f.first_id <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN f.first_id <> p.page_id THEN f.first_id END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND p.n >= 100
"""

OP4 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20
"""

#: {docs}: a relation with doc_id, text, source.
MIX = """
d AS (
  SELECT *, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || coalesce(text, '')), 1, 15))::BIGINT >> 24 AS cell
  FROM {docs}
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, list_element([3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE], ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::INTEGER) AS w
  FROM d GROUP BY source
), c AS (SELECT *, (2 * source_size)::DOUBLE AS cap, (2 * source_size)::DOUBLE / w AS ratio FROM s),
e AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - coalesce(sum(cap) OVER b, 0))
    / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS level
  FROM c WINDOW b AS (ORDER BY ratio, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (SELECT arg_min(level, ratio) AS level FROM e WHERE ratio > level),
t AS (
  SELECT source, source_size, CASE WHEN l.level IS NULL THEN cap ELSE least(cap, w * l.level) END AS target FROM c, l
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS base FROM t
), g AS (
  SELECT source, cell, sum(size)::BIGINT AS cell_size FROM d GROUP BY source, cell
), h AS (
  SELECT *, (sum(cell_size) OVER (PARTITION BY source ORDER BY cell) - cell_size)::BIGINT AS before FROM g
), mixed AS (
  SELECT d.*, p.source_size, p.target, (p.base * d.size
    + CASE WHEN h.before + h.cell_size <= floor(p.target)::BIGINT - p.base * p.source_size THEN d.size
           WHEN h.before < floor(p.target)::BIGINT - p.base * p.source_size
           THEN d.size * (floor(p.target)::BIGINT - p.base * p.source_size - h.before) // h.cell_size
           ELSE 0 END)::BIGINT AS taken
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
    JOIN h ON d.source IS NOT DISTINCT FROM h.source AND d.cell = h.cell
)
"""

OP6 = "WITH " + MIX.format(docs="documents") + " SELECT doc_id, size, source_size, target, taken FROM mixed"

ORACLES = {"op1_warc": OP1, "op4_topk": OP4, "op6_mixing": OP6}
