"""Structured content out of raw model text: code blocks and JSON objects."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import fixed_values as fixed
from scorelake.functions.values import named, strip_if_padded

# What a fenced block looks like.
_FENCE = "```"
_BLOCK = r"(?s)```[a-zA-Z0-9_+-]*\n.*?```"
_OPEN_BLOCK = r"(?s)```[a-zA-Z0-9_+-]*\n(.*)"


def _opens_with(block: Column, language: str) -> Column:
    return F.lower(F.substring_index(block, "\n", 1)) == _FENCE + language


def _block_body(block: Column) -> Column:
    start = F.locate("\n", block) + F.lit(1)
    return F.substr(block, start, F.length(block) - F.lit(len(_FENCE)) - start + F.lit(1))


def code_block(text: Column, prefer: tuple[str, ...] = ()) -> Column:
    """The fenced block to score: first of a preferred language, else the first.

    Languages count in preference order, then blocks in text order. An unclosed
    fence gives the text after it; no fence gives the whole text. Stripped.
    """
    blocks = F.regexp_extract_all(text, F.lit(_BLOCK), F.lit(0))

    def first_in(found: Column, language: str) -> Column:
        return F.get(F.filter(found, lambda b: _opens_with(b, language)), F.lit(0))

    def choose(found: Column) -> Column:
        wanted = [first_in(found, language) for language in prefer]
        return F.coalesce(*wanted, F.get(found, F.lit(0)))

    # Named once each: the regex runs once however many languages are preferred, and the choice is made once.
    chosen = named(named(blocks, choose), _block_body)
    unclosed = F.when(text.rlike(_OPEN_BLOCK), F.regexp_extract(text, _OPEN_BLOCK, 1))
    body = F.when(F.contains(text, F.lit(_FENCE)), F.coalesce(chosen, unclosed, text))
    return named(body.otherwise(text), strip_if_padded)


def brace_span(text: Column) -> Column:
    """From the first ``{`` to the last ``}``, or NULL when there is no such span."""
    first = F.locate("{", text)
    last = F.length(text) - F.locate("}", F.reverse(text)) + F.lit(1)
    whole = (first > 0) & F.contains(text, F.lit("}")) & (last > first)
    return F.when(whole, F.substr(text, first, last - first + F.lit(1)))


def _canonical_json(first: Column, second: Column) -> Column:
    """Canonical text of the first candidate that is a valid JSON object.

    The functions are local so that they travel to the executors by value.
    """
    # JSON has no NaN or infinity, Python's reader accepts them. NaN becomes a marker
    # object (see judging.score_value), infinities the largest finite values.
    largest = 1.7976931348623157e308
    constants = {"NaN": {"nan": None}, "Infinity": largest, "-Infinity": -largest}

    def canonical(candidate, decode):
        if candidate is None:
            return None
        try:
            parsed = decode(candidate)
        except (ValueError, RecursionError):
            return None
        return json.dumps(parsed) if isinstance(parsed, dict) else None

    def batch(a: pd.Series, b: pd.Series) -> pd.Series:
        # One decoder for the batch: json.loads makes a new one per text where constants are given.
        decode = json.JSONDecoder(parse_constant=constants.__getitem__).decode
        found = [canonical(x, decode) or canonical(y, decode) for x, y in zip(a, b, strict=True)]
        return pd.Series(found, dtype=object)

    return F.pandas_udf(batch, T.StringType())(first, second)


def with_json_object(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the JSON object in a reply, fenced candidate first; ``{}`` when there is none.

    NULL texts give ``{}``. Only the validity check runs in Python (Arrow batches):
    the JVM readers accept trailing text and reject repeated keys. Fields are read
    natively afterwards. The candidates are columns of their own so that the block
    search runs once.
    """
    reply = F.col(text)
    df = df.withColumn("_fenced", code_block(reply, fixed.CODE_LANGUAGES["none"]))
    df = df.withColumns(
        {
            "_first": brace_span(F.col("_fenced")),
            "_second": F.when(F.contains(reply, F.lit(_FENCE)), brace_span(reply)),
        }
    )
    found = _canonical_json(F.col("_first"), F.col("_second"))
    return df.withColumn(name, F.coalesce(found, F.lit("{}"))).drop("_fenced", "_first", "_second")


def with_judge_json(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds the JSON object in a judge reply: brace span only, no fence step."""
    df = df.withColumn("_first", brace_span(F.col(text)))
    found = _canonical_json(F.col("_first"), F.lit(None).cast("string"))
    return df.withColumn(name, F.coalesce(found, F.lit("{}"))).drop("_first")
