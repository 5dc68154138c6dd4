"""op3: the quality of every document, learned from the labels of two thirds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.common import is_held_out, may_learn
from scorelake.llm.quality import classify, fit


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs.where(may_learn(docs["doc_id"], 3, 1)), labels)
    scored = classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", is_held_out(scored["doc_id"], 3, 1).alias("held_out"), "score", "predicted")


QUERIES = {"op3_quality": op3_quality}
SQL: dict[str, str] = {}
