"""Hashed text features in numpy, and the pass over a table that learns from them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import summed
from scorelake.sources.workspace import new_folder

#: Code points of a text that are hashed at a time; bounds memory, not what is read.
PIECE = 1 << 16
_MULTIPLIERS = tuple(np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def n_gram_slots(symbols: np.ndarray, n: int, dims: int) -> np.ndarray:
    """A slot below dims for each run of n symbols; dims is a power of two."""
    if len(symbols) < n:
        return np.empty(0, np.int64)
    mixed = symbols[: len(symbols) - n + 1] * _MULTIPLIERS[0]
    for k in range(1, n):
        mixed = (mixed ^ (mixed >> np.uint32(15))) * _MULTIPLIERS[k] + symbols[k : len(symbols) - n + 1 + k] * _MULTIPLIERS[k - 1]
    mixed = (mixed ^ (mixed >> np.uint32(13))) * np.uint32(0x2545F491) + np.uint32(n)
    return (mixed >> np.uint32(32 - (dims - 1).bit_length())).astype(np.int64)


def counted(slots: Iterator[np.ndarray], dims: int) -> np.ndarray:
    total = np.zeros(dims, np.float32)
    for some in slots:
        total += np.bincount(some, minlength=dims)
    return total


def learn_pass(
    rows: DataFrame, text: str, tag: str, featurise: Callable[[str], np.ndarray | None], dims: int
) -> tuple[np.ndarray, int, list[str], np.ndarray]:
    """One pass over rows: in how many texts each feature occurs, and the count vectors of tagged rows.

    tag is a text column, NULL where a row only counts. featurise gives dims counts, or None for
    a text that says nothing. Returns (document frequencies, texts, tags, vectors); the caller bounds the tagged rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(dims, np.float64), 0
        for batch in batches:
            keys, vectors = [], []
            for text_, tag_ in zip(batch.column(0), batch.column(1), strict=True):
                vector = featurise(text_.as_py() or "")
                if vector is None:
                    continue
                seen += vector > 0
                n += 1
                if tag_.is_valid:
                    keys.append("=" + tag_.as_py())
                    vectors.append(np.minimum(vector, 65535).astype(np.uint16).tobytes())
            yield _batch(keys, vectors, [1.0] * len(keys))
        yield _batch(["-"], [seen.tobytes()], [float(n)])

    parts = rows.select(text, tag).mapInArrow(run, "key string, vec binary, weight double")
    folder_rows = _stored(parts)
    totals, weights = summed(folder_rows.where("key = '-'"), "float64")
    sample = folder_rows.where("key <> '-'").select("key", "vec").collect()
    sample.sort(key=lambda r: (r.key, bytes(r.vec)))
    vectors = np.array([np.frombuffer(r.vec, np.uint16) for r in sample], np.float32).reshape(len(sample), dims)
    frequency = totals.get("-", np.zeros(dims))
    return frequency, int(weights.get("-", 0)), [r.key[1:] for r in sample], vectors


def _stored(parts: DataFrame) -> DataFrame:
    folder = new_folder(parts.sparkSession, "features")
    parts.write.parquet(folder)
    return parts.sparkSession.read.parquet(folder)


def _batch(keys: list[str], vectors: list[bytes], weights: list[float]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.string()), pa.array(vectors, pa.binary()), pa.array(weights, pa.float64())],
        names=["key", "vec", "weight"],
    )


def inverse_frequency(frequency: np.ndarray, n: int) -> np.ndarray:
    return (np.log((n + 1.0) / (frequency + 1.0)) + 1.0).astype(np.float32)


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; zero rows stay zero."""
    norms = np.sqrt((x * x).sum(axis=-1, keepdims=True))
    return x / np.where(norms > 0, norms, 1)


def below_rate(rate: Column, *keys: str) -> Column:
    """True for about that share of the rows, by a hash of keys and of the row's place in the table.

    The place spreads repeated rows, so that a group of them is sampled like any others.
    """
    mixed = F.xxhash64(*keys, F.monotonically_increasing_id())
    return (F.pmod(mixed, F.lit(1 << 30)) / float(1 << 30)) < rate
