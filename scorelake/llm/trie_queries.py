"""op13: the prefix trie of rebuilt conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.prefix_trie import rebuilt, trie, turns_of


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(rebuilt(turns_of(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


SQL = {
    "op13_prefix_trie": """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos,
    coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS root,
    (4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ord(x)::BIGINT)),
      lambda a, x: list_reduce(list_prepend(xor(a, x), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda b, y: xor(b >> 1, 3988292384 * (b & 1))))) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM t)
), r AS (
  SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.root AND t.pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > h
), s AS (
  SELECT c.conv_id, coalesce(list({'r': role, 't': text} ORDER BY pos) FILTER (WHERE pos IS NOT NULL), []) AS turns
  FROM c LEFT JOIN r ON r.conv_id = c.conv_id GROUP BY c.conv_id
), p AS (
  SELECT conv_id, len(turns) AS n, turns, unnest(range(0, len(turns) + 1)) AS depth FROM s
), m AS (
  SELECT turns[1:depth] AS prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    CASE WHEN depth = 0 THEN 0 ELSE length(any_value(turns[depth].t)) END AS chars,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '') AS ends
  FROM p GROUP BY turns[1:depth], depth
), k AS (
  SELECT b.prefix, count(c.prefix) AS n_children, any_value(a.conv_id) AS parent_conv_id
  FROM m b LEFT JOIN m c ON c.depth = b.depth + 1 AND c.prefix[1:b.depth] = b.prefix
    LEFT JOIN (SELECT DISTINCT prefix, conv_id FROM m) a ON b.depth > 0 AND a.prefix = b.prefix[1:b.depth - 1]
  GROUP BY b.prefix
), w AS (
  SELECT b.prefix, CAST(sum((c.n_convs - 1) * c.chars) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE k.n_children = 0) AS n_leaves
  FROM m b JOIN m c ON c.depth >= b.depth AND c.prefix[1:b.depth] = b.prefix JOIN k ON k.prefix = c.prefix GROUP BY b.prefix
)
SELECT m.conv_id, m.depth, k.parent_conv_id, m.n_convs, k.n_children, w.n_leaves, w.saved_tokens, sha256(m.ends) AS ends_sha256
FROM m JOIN k ON k.prefix = m.prefix JOIN w ON w.prefix = m.prefix"""
}
QUERIES = {"op13_prefix_trie": op13_prefix_trie}
