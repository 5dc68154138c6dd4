"""op1: the language of every document, learned from two thirds of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.common import is_held_out, may_learn
from scorelake.llm.language_id import fit, identify


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(may_learn(docs["doc_id"], 3, 1)))
    scored = identify(docs.select("doc_id", "text"), model)
    return scored.select(
        "doc_id", is_held_out(scored["doc_id"], 3, 1).alias("held_out"), "lang_pred", "score", "similarity", "rejected"
    )


QUERIES = {"op1_language": op1_language}
SQL: dict[str, str] = {}
