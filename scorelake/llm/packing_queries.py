"""op8: every document packed into sequences of five permitted lengths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.packing import pack


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op8_packing": op8_packing}
SQL: dict[str, str] = {}
