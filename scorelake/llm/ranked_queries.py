"""op11: the best documents for each benchmark item."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.ranked import build_index, search
from scorelake.sources.workspace import new_folder


def op11_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = build_index(spark.read.parquet(f"{sf_dir}/documents.parquet"), new_folder(spark, "lexical"))
    return search(index, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = {
    "op11_search": r"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
), q AS (
  SELECT item_id, term, count(*) AS times FROM (
    SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark) GROUP BY ALL
), n AS (
  SELECT row, any_value(doc_id) AS doc_id, count(*) AS n FROM d GROUP BY row
), s AS (
  SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM n
), t AS (
  SELECT row, term, count(*) AS tf FROM d WHERE term IN (SELECT term FROM q) GROUP BY ALL
), w AS (
  SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w
  FROM t, s GROUP BY term, n_docs
), p AS (
  SELECT q.item_id, n.doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n.n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM t JOIN q USING (term) JOIN w USING (term) JOIN n USING (row), s GROUP BY q.item_id, t.row, n.doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM p WHERE score > 0 QUALIFY rank <= 20"""
}
QUERIES = {"op11_search": op11_search}
