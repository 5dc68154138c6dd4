"""Human label sheets: a Markdown worksheet and its JSON key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import schemas
from scorelake.functions.values import strip

# The worksheet's line formats.
_ITEM = r"(?m)^## Item "
_FIELDS = {
    "item": r"^(\d+)",
    "expected_pattern": r"^\d+[^\n]*expected technique: `([^`\n]*)`",
    "technique_present": r"(?m)^- technique_present:[ \t]*(yes|no|partial)",
    "craft": r"(?m)^- craft \(1-5\):[ \t]*(\d)",
    "notes": r"(?m)^- notes:[ \t]*([^\n]*)",
}


def parse_worksheets(sheets: DataFrame, text: str = "text") -> DataFrame:
    """Label rows out of worksheet texts; an unfilled field is NULL."""
    sections = F.slice(F.split(text, _ITEM), 2, F.size(F.split(text, _ITEM)))
    items = sheets.select(F.explode(sections).alias("_section"))

    def field(name: str) -> Column:
        value = F.nullif(strip(F.regexp_extract("_section", _FIELDS[name], 1)), F.lit(""))
        return value.try_cast("int") if name in ("item", "craft") else value

    return items.select(*(field(n).alias(n) for n in _FIELDS))


def read_worksheets(spark: SparkSession, path: str) -> DataFrame:
    sheets = spark.read.text(path, wholetext=True)
    return parse_worksheets(sheets.withColumnRenamed("value", "text"))


def parse_keys(sheets: DataFrame, text: str = "text") -> DataFrame:
    """Key rows out of texts that each hold a JSON array of objects."""
    rows = F.from_json(text, T.ArrayType(schemas.GOLDEN_KEY))
    return sheets.select(F.inline(rows))


def read_key(spark: SparkSession, path: str) -> DataFrame:
    """The rows of key sheets; a sheet is small, so each file is one text."""
    return parse_keys(spark.read.text(path, wholetext=True).withColumnRenamed("value", "text"))
