"""op7: the five nearest vectors of every fiftieth one, among all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.ann import nearest


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors.where(F.col("vec_id") % 50 == 0), vectors, k=5)


SQL = {
    "op7_nearest": """
WITH v AS (
  SELECT DISTINCT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), n AS (
  SELECT vec_id, e, sqrt(list_reduce(list_transform(e, lambda x: x * x), lambda x, y: x + y)) AS norm FROM v
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    least(1.0, greatest(-1.0, list_inner_product(q.e, c.e) / (q.norm * c.norm))) AS score
  FROM n q JOIN n c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
QUERIES = {"op7_nearest": op7_nearest}
