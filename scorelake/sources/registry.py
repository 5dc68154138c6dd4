"""Model registry and run manifest."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from scorelake import schemas
from scorelake.operators.planning import with_labels

PROVIDERS = ("openrouter", "local")


def models_from_toml(spark: SparkSession, text: str) -> DataFrame:
    """Models of a TOML registry of ``[[model]]`` tables, in file order."""
    entries = tomllib.loads(text).get("model", [])
    unknown = [e.get("provider") for e in entries if e.get("provider") not in PROVIDERS]
    if unknown:
        raise ValueError(f"unknown provider: {unknown[0]}")
    defaults = {"input_cost_per_mtok": 0.0, "output_cost_per_mtok": 0.0, "skip_by_default": False}
    names = schemas.MODELS.fieldNames()
    rows = [tuple({**defaults, **e}.get(n) for n in names) for e in entries]
    return with_labels(spark.createDataFrame(rows, schemas.MODELS))


def read_models(spark: SparkSession, path: str) -> DataFrame:
    """The registry file at a path that Spark can read."""
    text = spark.read.text(path, wholetext=True).first()
    return models_from_toml(spark, text["value"] if text else "")


def manifest(spark: SparkSession, fields: Mapping[str, object]) -> DataFrame:
    """A one-row manifest of a run."""
    row = tuple(fields.get(n) for n in schemas.MANIFEST.fieldNames())
    return spark.createDataFrame([row], schemas.MANIFEST)


def write_manifest(row: DataFrame, path: str) -> None:
    row.coalesce(1).write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The manifest at a path, with its nested fields."""
    return spark.read.schema(schemas.MANIFEST).option("multiLine", True).json(path)


def manifest_rows(models: Sequence[Mapping[str, object]]) -> list[tuple]:
    """Registry entries as rows of the manifest's model list."""
    return [tuple(m.get(n) for n in schemas.MODELS.fieldNames()) for m in models]
