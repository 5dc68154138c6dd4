"""Typed reading of JSON fields, as Spark SQL text over a variant column.

Each reader names the document column and a path. The document is parsed once into
the variant column; a reader only walks it.
"""

from __future__ import annotations


def value_sql(doc: str, path: str, dtype: str = "variant") -> str:
    """The field read as a type, NULL when it is missing or of another type."""
    return f"try_variant_get({doc}, '{path}', '{dtype}')"


def kind_sql(doc: str, path: str) -> str:
    """Type name of the field, e.g. BIGINT, STRING, VOID for null; NULL when missing."""
    return f"schema_of_variant({value_sql(doc, path)})"


def score_sql(doc: str, path: str, kind: str) -> str:
    """A score in 0..1: numbers clamp, true is 1, text and gaps are 0, NaN is NULL.

    ``kind`` is the column that holds the field's type name.
    """
    return (
        f"CASE WHEN {kind} IS NULL THEN 0D "
        f"WHEN {kind} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' "
        f"THEN least(greatest({value_sql(doc, path, 'double')}, 0D), 1D) "
        f"WHEN {kind} = 'BOOLEAN' THEN CAST({value_sql(doc, path, 'boolean')} AS DOUBLE) "
        f"WHEN {kind} = 'OBJECT<nan: VOID>' THEN NULL ELSE 0D END"
    )


def text_sql(doc: str, path: str, kind: str) -> str:
    """The field as text, empty when missing."""
    text = value_sql(doc, path, "string")
    return (
        f"CASE WHEN {kind} IS NULL THEN '' WHEN {kind} = 'VOID' THEN 'None' "
        f"WHEN {kind} = 'BOOLEAN' THEN initcap({text}) "
        f"WHEN {kind} RLIKE '^(OBJECT|ARRAY)' THEN to_json({value_sql(doc, path)}) "
        f"ELSE {text} END"
    )


def truthy_sql(doc: str, path: str, kind: str) -> str:
    """JSON truthiness: zero, empty, null and missing are false; text "false" is true."""
    return (
        f"coalesce(CASE WHEN {kind} = 'BOOLEAN' THEN {value_sql(doc, path, 'boolean')} "
        f"WHEN {kind} = 'STRING' THEN {value_sql(doc, path, 'string')} <> '' "
        f"WHEN {kind} RLIKE '^(BIGINT|DECIMAL|DOUBLE|FLOAT)' "
        f"THEN {value_sql(doc, path, 'double')} <> 0D "
        f"WHEN {kind} RLIKE '^(OBJECT|ARRAY)' "
        f"THEN to_json({value_sql(doc, path)}) NOT IN ('{{}}', '[]') END, false)"
    )


def line_sql(doc: str, path: str) -> str:
    """A JSON integer or a digit string; booleans, fractions and the rest are missing."""
    kind, text = kind_sql(doc, path), f"trim({value_sql(doc, path, 'string')})"
    return (
        f"CASE WHEN {kind} = 'BIGINT' OR ({kind} = 'STRING' AND {text} RLIKE '^[0-9]+$') "
        f"THEN try_cast({text} AS BIGINT) END"
    )
