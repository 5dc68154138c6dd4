"""Bug-localization columns, layer by layer over the reply's JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.functions import localization as rules
from scorelake.functions.json_values import line_sql, value_sql

_SCRATCH = ("_doc", "_given_start", "_given_end", "_given_line")


def with_span(df: DataFrame, document: str = "parsed") -> DataFrame:
    """Adds ``_start`` and ``_end`` of the predicted lines, NULL without a prediction.

    One missing end copies the other, both missing fall back to ``line``, and a
    reversed span is turned round.
    """
    df = df.withColumn("_doc", F.expr(f"try_parse_json({document})"))
    df = df.withColumns(
        {
            "_given_start": F.expr(line_sql("_doc", "$.start_line")),
            "_given_end": F.expr(line_sql("_doc", "$.end_line")),
            "_given_line": F.expr(line_sql("_doc", "$.line")),
        }
    )
    first = F.expr("coalesce(_given_start, _given_end, _given_line)")
    last = F.expr("coalesce(_given_end, _given_start, _given_line)")
    df = df.withColumns({"_start": F.least(first, last), "_end": F.greatest(first, last)})
    return df.drop(*_SCRATCH)


def with_hits(df: DataFrame, fault_lines: Column) -> DataFrame:
    """Adds the localization columns of a scored row; needs the span."""
    start, end = F.col("_start"), F.col("_end")
    return df.withColumns(
        {
            "predicted_line": F.coalesce(start, F.lit(-1)),
            "predicted_end_line": F.coalesce(end, F.lit(-1)),
            "localized": rules.covers(start, end, fault_lines),
            "localized_within_1": rules.covers(start, end, fault_lines, 1),
        }
    )


def with_patch(df: DataFrame, document: str, payload: str = "payload") -> DataFrame:
    """Adds ``patched``: the source to test, NULL when no repair is due; needs the span."""
    df = df.withColumn("_given_fix", F.expr(value_sql(f"try_parse_json({document})", "$.proposed_fix")))
    text = value_sql("_given_fix", "$", "string")
    fix = F.expr(f"if(schema_of_variant(_given_fix) = 'STRING', {text}, NULL)")
    fields = F.col(payload)
    start, end = F.col("_start"), F.col("_end")
    df = df.withColumns(
        {
            "_fix": fix,
            "_lines": F.when(start.isNotNull(), rules.split_lines(fields["source"])),
        }
    )
    lines = F.col("_lines")
    df = df.withColumn(
        "_due",
        rules.repair_due(lines, start, end, F.col("_fix"), fields["test"], fields["module_name"]),
    )
    df = df.withColumn(
        "_block", F.when(F.col("_due"), rules.fix_block(lines, start, end, F.col("_fix")))
    )
    patched = F.when(F.col("_due"), rules.replace_lines(lines, start, end, F.col("_block")))
    return df.withColumn("patched", patched).drop("_given_fix", "_fix", "_lines", "_due", "_block")
