"""op12: every document's token ids through Arrow files of equal-length sequences."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scorelake.llm.token_files import read_files, write_files
from scorelake.llm.warc import qualified
from scorelake.sources.workspace import new_folder

VOCABULARY = "byte_bpe_50k.json"


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = qualified(spark, new_folder(spark, "tokens"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_files(write_files(docs, folder, public_tokenizers.path(VOCABULARY)), folder)


QUERIES = {"op12_token_files": op12_token_files}
SQL: dict[str, str] = {}
