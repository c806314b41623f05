"""The sharding law as DuckDB SQL; DuckDB has no crc32, so the query as a whole has no oracle."""

SQL = """
WITH RECURSIVE jumps AS (
  SELECT row_number() OVER () AS id, doc_id, text, n, CAST((CASE WHEN COALESCE(doc_id, 0) < 0 THEN COALESCE(doc_id, 0)::HUGEINT + 18446744073709551616 ELSE COALESCE(doc_id, 0)::HUGEINT END) AS HUGEINT) AS state, CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS j
  FROM documents, (VALUES (40), (41)) shards(n)
  UNION ALL
  SELECT id, doc_id, text, n, s, j, CAST(floor((j + 1) * (2147483648.0::DOUBLE / ((s // 8589934592) + 1)::DOUBLE)) AS BIGINT)
  FROM (SELECT *, (state * 2862933555777941757 + 1) % 18446744073709551616 AS s FROM jumps WHERE j < n)
), ends AS (SELECT doc_id, text, max(b) FILTER (n = 40) AS shard, max(b) FILTER (n = 41) AS grown_shard FROM jumps GROUP BY doc_id, text)
SELECT doc_id, CAST(octet_length(encode(COALESCE(text, ''))) + 16 AS BIGINT) AS size, CAST(shard AS INTEGER) AS shard, CAST(grown_shard AS INTEGER) AS grown_shard FROM ends
"""
