"""op9: log probabilities of every document, learned from nine tenths of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.common import is_held_out, may_learn
from scorelake.llm.language_model import fit, score


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(may_learn(docs["doc_id"], 10, 0)))
    return score(docs, model, is_held_out(docs["doc_id"], 10, 0)).withColumnRenamed("mark", "held_out")


QUERIES = {"op9_language_model": op9_language_model}
SQL: dict[str, str] = {}
