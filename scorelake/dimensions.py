"""The fixed track tables as DataFrames. A handful of rows, so broadcasting is safe."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed


def track_dimension(spark: SparkSession) -> DataFrame:
    """(track, language, category, headline, supports_multishot)."""
    schema = (
        "track string, language string, category string, headline boolean, "
        "supports_multishot boolean"
    )
    return F.broadcast(spark.createDataFrame(list(fixed.TRACKS), schema))


def judge_dimension(spark: SparkSession) -> DataFrame:
    """(track, judge): which judges score a track."""
    return F.broadcast(
        spark.createDataFrame(list(fixed.JUDGES_BY_TRACK), "track string, judge string")
    )
