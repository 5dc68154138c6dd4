"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Tasks that merge partial vectors before the driver sees them: bounds what it receives.
MERGERS = 32


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; NULL for a NULL id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def is_held_out(doc_id: Column, modulus: int, value: int) -> Column:
    """True for the fold that is never learned from; a NULL id is in no fold."""
    return F.coalesce(remainder(doc_id, modulus) == value, F.lit(False))


def may_learn(doc_id: Column, modulus: int, value: int) -> Column:
    """True for rows that may be learned from; a NULL id never is."""
    return F.coalesce(remainder(doc_id, modulus) != value, F.lit(False))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    """Array of a text's words; empty for NULL or blank texts."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, r"[\x20\x09-\x0D]+"))


def with_outputs(
    docs: DataFrame, inputs: list[str], outputs: T.StructType, compute: Callable[[list[pa.Array]], list]
) -> DataFrame:
    """Every column of docs and then the outputs, computed batch by batch without a shuffle.

    compute gets one Arrow array per input and gives one sequence per output. A column
    of docs that has an output's name, in any case, is replaced.
    """
    new = {f.name.lower() for f in outputs}
    kept = [i for i, f in enumerate(docs.schema.fields) if f.name.lower() not in new]
    at = [docs.columns.index(c) for c in inputs]
    schema = T.StructType([docs.schema.fields[i] for i in kept] + list(outputs))
    types = [to_arrow_type(f.dataType) for f in outputs]
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = compute([batch.column(i) for i in at])
            arrays = [x if isinstance(x, pa.Array) else pa.array(x, type=t) for x, t in zip(made, types, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept] + arrays, names=names)

    return docs.mapInArrow(run, schema)


def summed(parts: DataFrame, dtype: str) -> tuple[dict[str, np.ndarray], dict[str, float]]:
    """Sums vectors by key: rows (key string, vec binary, weight double), at most MERGERS per key on the driver.

    Keys must be few; every vector of a key has the same length.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        weights: dict[str, float] = {}
        for batch in batches:
            for key, vec, weight in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                values = np.frombuffer(vec, dtype)
                totals[key] = totals[key] + values if key in totals else values
                weights[key] = weights.get(key, 0.0) + weight
        keys = list(totals)
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.string()), pa.array([totals[k].astype(dtype).tobytes() for k in keys], pa.binary()),
             pa.array([weights[k] for k in keys], pa.float64())],
            names=["key", "vec", "weight"],
        )

    totals: dict[str, np.ndarray] = {}
    weights: dict[str, float] = {}
    for row in parts.repartition(MERGERS).mapInArrow(merge, "key string, vec binary, weight double").collect():
        values = np.frombuffer(row.vec, dtype)
        totals[row.key] = totals[row.key] + values if row.key in totals else values
        weights[row.key] = weights.get(row.key, 0.0) + row.weight
    return totals, weights
