"""Summary tables of runs as CSV, one folder per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.values import decoded, nan_to_null
from scorelake.operators.metrics import METRICS
from scorelake.schemas import summary_schema
from scorelake.sources.workspace import path_exists

_RUN_OF_PATH = r"/([^/]+)/summary\.csv(?:/[^/]*)?$"


def write_summary(summary: DataFrame, path: str) -> None:
    """Write one summary. It has one row per model and track, so one file holds it."""
    summary.coalesce(1).write.mode("error").option("header", True).csv(path)


def _by_name(files: DataFrame, schema: T.StructType, *kept: str) -> DataFrame:
    """Rows of CSV texts (text, ...) by the names in each text's own first line.

    Texts may differ in columns and in their order; a column that a text does not have
    is NULL, one the schema does not know is left out. A value of another type is NULL.
    A summary is small, so each text is one value.
    """
    lines = F.filter(F.split("text", r"\r\n|\r|\n"), lambda x: F.trim(x) != "")
    split = files.withColumn("_lines", lines).withColumn("_header", F.get("_lines", F.lit(0)))
    commas = F.length("_header") - F.length(F.replace(F.col("_header"), F.lit(","), F.lit("")))
    width = (split.agg(F.max(commas)).first()[0] or 0) + 1
    cells = ", ".join(f"c{k} string" for k in range(width))

    def read(line: Column) -> Column:
        row = F.from_csv(line, cells)
        return F.transform(F.array(*(row[f"c{k}"] for k in range(width))), lambda v: F.trim(v))

    rows = split.select(*kept, "_header", F.posexplode("_lines").alias("_line", "_text")).filter("_line > 0")
    rows = rows.withColumns({"_names": read(F.col("_header")), "_values": read(F.col("_text"))})

    def value(field: T.StructField) -> Column:
        place = F.array_position("_names", field.name).cast("int") - F.lit(1)
        return F.nullif(F.get("_values", place), F.lit("")).try_cast(field.dataType).alias(field.name)

    return nan_to_null(rows.select(*kept, *(value(f) for f in schema.fields)))


def read_summary(spark: SparkSession, path: str, metrics=None) -> DataFrame:
    """Read one summary; empty fields are NULL, a missing file has no rows."""
    schema = summary_schema(metrics or METRICS)
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return _by_name(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"), schema)


def read_all_summaries(spark: SparkSession, root: str, metrics=None) -> DataFrame:
    """Summaries of every run below a folder, with ``run_id`` and ``run_mtime``."""
    schema = summary_schema(metrics or METRICS)
    path = f"{root}/*/summary.csv"
    if not path_exists(spark, path):
        run = [T.StructField("run_id", T.StringType()), T.StructField("run_mtime", T.TimestampType())]
        return spark.createDataFrame([], T.StructType([*run, *schema.fields]))
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("text"),
        F.regexp_extract(decoded(F.col("_metadata.file_path")), _RUN_OF_PATH, 1).alias("run_id"),
        F.col("_metadata.file_modification_time").alias("run_mtime"),
    )
    return _by_name(files, schema, "run_id", "run_mtime")


def list_runs(summaries: DataFrame) -> DataFrame:
    """Run ids, newest first by file time."""
    return (
        summaries.groupBy("run_id")
        .agg(F.max("run_mtime").alias("run_mtime"))
        .orderBy(F.desc("run_mtime"), F.desc("run_id"))
    )


def of_run(rows: DataFrame, run_id: str) -> DataFrame:
    """Rows of one run; partitioned tables read only that run's folder."""
    return rows.filter(F.col("run_id") == run_id)


def write_report(tables: DataFrame, path: str) -> None:
    """Write report tables, one folder per ranked table."""
    tables.write.mode("error").partitionBy("track").option("header", True).csv(path)
