"""Missing-value, numeric and rounding rules shared by every operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import fixed_values as fixed

_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTIONAL = (T.FloatType, T.DoubleType)


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN into NULL in every float column; run once when data enters."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, _FRACTIONAL)]
    if not floats:
        return df
    return df.withColumns({c: F.nanvl(F.col(c), F.lit(None).cast("double")) for c in floats})


def dtype_of(df: DataFrame, name: str) -> T.DataType | None:
    """Declared type of a column, or None when the table has no such column."""
    return next((f.dataType for f in df.schema.fields if f.name == name), None)


def number_sql(df: DataFrame, name: str) -> str:
    """A column read as a number: unparsable text and NaN are missing."""
    dtype = dtype_of(df, name)
    if dtype is None:
        return "CAST(NULL AS DOUBLE)"
    if isinstance(dtype, _INTEGRAL):
        return f"`{name}`"
    if isinstance(dtype, T.BooleanType):
        return f"CAST(`{name}` AS INT)"
    if isinstance(dtype, T.DoubleType):
        return f"nanvl(`{name}`, NULL)"
    return f"nanvl(try_cast(`{name}` AS DOUBLE), NULL)"


def truth_sql(df: DataFrame, name: str) -> str:
    """A column read as 1/0: NULL and NaN are missing, so is any text."""
    dtype = dtype_of(df, name)
    if isinstance(dtype, T.BooleanType):
        return f"CAST(`{name}` AS INT)"
    if isinstance(dtype, _INTEGRAL):
        return f"CAST(`{name}` <> 0 AS INT)"
    if isinstance(dtype, _FRACTIONAL):
        return f"CAST(nanvl(`{name}`, NULL) <> 0 AS INT)"
    return "CAST(NULL AS INT)"


def number(df: DataFrame, name: str) -> Column:
    return F.expr(number_sql(df, name))


def truth(df: DataFrame, name: str) -> Column:
    return F.expr(truth_sql(df, name))


def strip(text: Column) -> Column:
    """Remove leading and trailing whitespace, Unicode whitespace included."""
    return F.btrim(text, F.lit(fixed.PY_WHITESPACE))


def strip_if_padded(text: Column) -> Column:
    """The same as strip. btrim indexes the whole text, so only texts with whitespace at an end go through it.

    The text is read several times: it should be a column or a name given by ``named``.
    """
    ends = (F.left(text, F.lit(1)), F.right(text, F.lit(1)))
    padded = [F.contains(F.lit(fixed.PY_WHITESPACE), end) for end in ends]
    return F.when(padded[0] | padded[1], strip(text)).otherwise(text)


def named(value: Column, use: Callable[[Column], Column]) -> Column:
    """What ``use`` makes of a value that it reads several times and that is computed once.

    The optimizer shares no expression between the branches of a condition; the one element of an array has a name.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def round_half_even(name: str, digits: int) -> Column:
    """Round the exact binary value of a column, ties to even.

    ``F.round`` and ``F.bround`` round the printed decimal instead, which moves
    values such as 0.00015 the other way. Splitting the value in two halves of 26
    bits makes value * 10**digits an exact sum of two doubles, so the comparison
    with the midpoint is exact. Holds for digits <= 6 and products below 2**52.
    """
    x, scale = f"abs(`{name}`)", f"{10**digits}D"
    high = f"({x} * 134217729D - ({x} * 134217729D - {x}))"
    upper, lower = f"{high} * {scale}", f"({x} - {high}) * {scale}"
    base = f"CAST(floor({upper} + {lower}) AS DOUBLE)"
    past = f"(({upper} - {base} - 0.5D) + {lower})"
    whole = (
        f"CASE WHEN {past} < 0 THEN {base} WHEN {past} > 0 THEN {base} + 1 "
        f"ELSE {base} + pmod({base}, 2D) END"
    )
    # Adding zero turns -0.0 into 0.0.
    return F.expr(f"signum(`{name}`) * ({whole}) / {scale} + 0D")


def first_present(df: DataFrame, names) -> str | None:
    """First of ``names`` that is a column of the table (schema level, not row level)."""
    columns = set(df.columns)
    return next((n for n in names if n in columns), None)


def available(df: DataFrame, names) -> list[str]:
    """Those of ``names`` that are columns of the table, in the given order."""
    columns = set(df.columns)
    return [n for n in names if n in columns]


def required(df: DataFrame, holds: Column, message: Column) -> DataFrame:
    """The rows of df; a row for which the condition does not hold ends the query.

    The check is a filter of a kind the optimizer neither removes with unused columns
    nor evaluates on its own while planning.
    """
    every = F.monotonically_increasing_id() >= 0
    return df.filter(F.when(every & holds, True).otherwise(F.raise_error(message).cast("boolean")))


def decoded(path: Column) -> Column:
    """A file's path with its folders as they are named; a plus sign stands for itself."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)
