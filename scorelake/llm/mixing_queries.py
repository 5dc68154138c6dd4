"""op5: the documents a temperature mixture takes, within a budget of the table's own size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.mixing import mix

#: No source is read more than this many times over.
REPETITION = 1.25
BLOCKS = 64


def op5_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    mixed = mix(docs, target="repetition", limit=REPETITION, budget=1.0, blocks=BLOCKS)
    return mixed.select("doc_id", "source", "n_tokens", "pass", "block", "slot")


_WEIGHT = "exp(ln(share) * (p / 1000000.0::DOUBLE))"


def _round(name: str, grid: str) -> str:
    return f"""{name} AS (
  SELECT coalesce(min(p), 1000000) AS p FROM (
    SELECT p, max({_WEIGHT} / tokens) * max(total)::DOUBLE / sum({_WEIGHT}) AS passes
    FROM s CROSS JOIN ({grid}) GROUP BY p
  ) WHERE passes <= {REPETITION}
)"""


SQL = {
    "op5_mixture": rf"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS key, coalesce(doc_id::VARCHAR, '') AS id_text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS n_tokens
  FROM documents
), t AS (
  SELECT key, sum(n_tokens)::BIGINT AS tokens FROM d WHERE n_tokens > 0 GROUP BY key
), s AS (
  SELECT key, tokens, total, tokens / total::DOUBLE AS share FROM t, (SELECT sum(tokens)::BIGINT AS total FROM t)
), {_round("r1", "SELECT unnest(range(0, 1000001, 10000)) AS p")},
{_round("r2", "SELECT unnest(range(greatest(p - 9900, 0), p + 1, 100)) AS p FROM r1")},
{_round("r3", "SELECT unnest(range(greatest(p - 99, 0), p + 1, 1)) AS p FROM r2")},
w AS (
  SELECT key, tokens, total, {_WEIGHT} AS w FROM s, r3
), q AS (
  SELECT key, tokens, floor(round(w / (SELECT sum(w) FROM w), 12) * total::DOUBLE)::BIGINT AS quota FROM w
), e AS (
  SELECT d.*, tokens, quota, unnest(range(0, ceil(quota / tokens)::BIGINT)) AS pass
  FROM d JOIN q USING (key) WHERE n_tokens > 0
), h AS (
  SELECT *, md5(concat_ws('|', id_text, pass::VARCHAR)) AS hash FROM e
), b AS (
  SELECT *, pass * tokens + coalesce(sum(n_tokens) OVER (
      PARTITION BY key, pass ORDER BY hash, id_text, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spot
  FROM h
)
SELECT doc_id, source, n_tokens, pass::INT AS pass, (spot * {BLOCKS} // quota)::INT AS block, md5(concat_ws('|', key, hash)) AS slot
FROM b WHERE spot < quota
UNION ALL
SELECT doc_id, source, n_tokens, 0, 0, md5(concat_ws('|', key, md5(concat_ws('|', id_text, '0')))) FROM d WHERE n_tokens = 0"""
}
QUERIES = {"op5_mixture": op5_mixture}
