"""JSON-lines facts: responses, scored rows, execution logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.functions.values import nan_to_null
from scorelake.sources.workspace import path_exists

CORRUPT = "_corrupt_record"
#: JSON repeats its names in every line, so lines are packed; a packed file is read by one task and is kept small.
_LINES = {"compression": "gzip", "maxRecordsPerFile": 500_000}


def read_jsonl(
    spark: SparkSession, path: str, schema: T.StructType, open_columns: bool = False
) -> DataFrame:
    """Rows of a JSON-lines folder or file; no rows when it does not exist.

    A line that is not JSON keeps its text in ``_corrupt_record``. With ``open_columns``,
    columns that the schema does not declare are kept too, with the types found in a pass
    over the file; without it they are left out.
    """
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType(), True)])
    if not path_exists(spark, path):
        return spark.createDataFrame([], wide)
    if open_columns:
        known = {f.name for f in wide.fields}
        found = spark.read.json(path).schema.fields
        wide = T.StructType([*wide.fields, *(f for f in found if f.name not in known)])
    rows = spark.read.schema(wide).option("columnNameOfCorruptRecord", CORRUPT).json(path)
    return nan_to_null(rows)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """Append rows to a folder of gzipped JSON lines; gaps are written as null."""
    nan_to_null(rows).write.mode("append").options(**_LINES, ignoreNullFields=False).json(path)


def write_sparse(rows: DataFrame, path: str) -> None:
    """Write rows to a new folder of gzipped JSON lines without their empty fields.

    The path must not exist: a table that is being read is never overwritten, its
    successor is written beside it.
    """
    nan_to_null(rows).write.mode("error").options(**_LINES, ignoreNullFields=True).json(path)


def write_partitioned(rows: DataFrame, path: str, by=("run_id", "track")) -> None:
    """Append facts as Parquet, one folder per run and track, so readers can prune."""
    nan_to_null(rows).write.mode("append").partitionBy(*by).parquet(path)


def read_run(spark: SparkSession, path: str, run_id: str, track: str | None = None) -> DataFrame:
    """One run of partitioned facts, or one track of it; other folders are not read."""
    rows = spark.read.option("mergeSchema", True).parquet(path).filter(F.col("run_id") == run_id)
    return rows if track is None else rows.filter(F.col("track") == track)
