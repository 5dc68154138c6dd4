"""A training corpus from raw documents: quality, language, near-duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; all but the last give the columns of
docs. Between stages, rows are written as Parquet and read again.

Defined cases: NULL and empty texts are rejected by the first two stages, are documents of their own
for near-duplicates and cost the mixture nothing; a NULL id or source is a value like any other. Repeated rows
are judged alike, and of near-duplicates the rows of the smallest id stay. Very long texts are read whole by every
stage. An empty table gives an empty result at every stage, and columns of docs whose names clash with a stage's own are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake.llm.common import may_learn
from scorelake.llm.language_id import fit as fit_language
from scorelake.llm.language_id import identify
from scorelake.llm.mixing import mix
from scorelake.llm.near_dedup import keep_one
from scorelake.llm.packing import pack
from scorelake.llm.quality import classify
from scorelake.llm.quality import fit as fit_quality
from scorelake.sources.workspace import new_folder

#: No source is repeated more often than this; without a token budget every document stays.
REPETITION = 2.0
ORACLE_SQL: str | None = None  # trained models and best-fit decisions have no SQL


def _renamed(docs: DataFrame) -> tuple[DataFrame, dict[str, str], list[Column]]:
    """docs under names no output has, the new names, and the columns that give the old ones back."""
    new = [f"c{i}_" for i in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new, strict=True)), [F.col(n).alias(o) for o, n in zip(docs.columns, new, strict=True)]


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the quality classifier accepts; it learns from the labels of the documents given."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs.where(may_learn(docs["doc_id"], 3, 1)), labels)
    inner, name, back = _renamed(docs)
    return classify(inner, model, text=name["text"]).where("predicted = 1").select(*back)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents near enough to a language; the classifier learns from the documents given."""
    model = fit_language(docs.where(may_learn(docs["doc_id"], 3, 1)))
    inner, name, back = _renamed(docs)
    return identify(inner, model, text=name["text"]).where("NOT rejected").select(*back)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return keep_one(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, those of small sources repeated towards even weights."""
    inner, name, back = _renamed(docs)
    mixed = mix(inner, target="repetition", limit=REPETITION, source=name["source"], doc_id=name["doc_id"], text=name["text"])
    return mixed.select(*back)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of the permitted lengths."""
    return pack(docs)


STAGES = [
    ("quality", good_quality),
    ("language", known_language),
    ("near_duplicates", one_of_each),
    ("mixture", mixture),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder of tables."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        folder = new_folder(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)
