"""op6: fingerprints of every document and of its edited text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.sketch import as_text, compare_with_edit


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = compare_with_edit(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited_text").cast("binary"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


_HASHES = r"""list_transform(range(1, greatest(len({w}) - 4, 1) + 1),
        lambda i: md5(array_to_string({w}[i:i+4], ' ')))"""
_SKETCH = """CASE WHEN len({w}) = 0 THEN []::VARCHAR[]
    WHEN len(list_filter({h}, lambda x: x < '2')) > 0
    THEN list_sort(list_distinct(list_transform(list_filter({h}, lambda x: x < '2'), lambda x: substr(x, 1, 12))))
    ELSE [substr(list_min({h}), 1, 12)] END"""
_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"
_LIKE = """CASE WHEN len({a}) + len({b}) = 0 THEN 1.0::DOUBLE
    ELSE len(list_intersect({a}, {b}))::DOUBLE / len(list_distinct(list_concat({a}, {b}))) END"""

SQL = {
    "op6_fingerprints": rf"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), n AS (
  SELECT doc_id, text, coalesce(lead(text) OVER w, first_value(text) OVER w) AS next_text
  FROM d WINDOW w AS (ORDER BY doc_id DESC NULLS LAST, text)
), e AS (
  SELECT doc_id, text, next_text,
    substr(text, 1, length(text) - length(text) // 2) || substr(next_text, 1, length(text) // 2) AS edited_text
  FROM n
), w AS (
  SELECT *, {_WORDS.format(t="text")} AS w0, {_WORDS.format(t="edited_text")} AS w1,
    {_WORDS.format(t="next_text")} AS w2 FROM e
), h AS (
  SELECT *, {_HASHES.format(w="w0")} AS h0, {_HASHES.format(w="w1")} AS h1, {_HASHES.format(w="w2")} AS h2 FROM w
), s AS (
  SELECT *, {_SKETCH.format(w="w0", h="h0")} AS s0, {_SKETCH.format(w="w1", h="h1")} AS s1,
    {_SKETCH.format(w="w2", h="h2")} AS s2 FROM h
)
SELECT doc_id, length(text) AS n_chars, sha256(edited_text) AS edited_sha256,
  array_to_string(s0, '') AS fingerprint, array_to_string(s1, '') AS edited_fingerprint,
  {_LIKE.format(a="s0", b="s1")} AS near_edited, {_LIKE.format(a="s0", b="s2")} AS near_next
FROM s"""
}
QUERIES = {"op6_fingerprints": op6_fingerprints}
