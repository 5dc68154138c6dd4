"""Quality classification by votes of nearest labelled neighbours.

A text becomes a vector of hashed features: runs of one to four character classes (letters by case,
digits, white space, and other characters as they are; repeated classes once), words, and how its
words repeat. Weights are the square root of relative frequency times inverse document frequency.
A truncated singular value decomposition of the labelled vectors gives the latent space.

The labelled vectors in that space are few by a stated bound (SAMPLE_ROWS) and go to every task;
each text's cosines with all of them are computed exactly, in blocks. The NEIGHBOURS most alike
vote for their labels with weights that grow with the cosine. Document frequencies come from all
texts that may be learned from.

Defined cases: a NULL or blank text scores 0; if nothing could be learned every other text scores
0.5. Rows with NULL ids or labels teach nothing; an id with several labels counts with their mean,
and rows of equal id with a label each teach. A very long text is read whole, in pieces of PIECE code points,
beside the list of its words. Among neighbours of equal cosine at the last place, which of them vote is not
defined. A column of docs that has an output's name is replaced,
and an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake.llm.common import with_outputs
from scorelake.llm.features import (
    PIECE, below_rate, code_points, inverse_frequency, learn_pass, n_gram_slots, unit_rows,
)

DIMS = 2048
#: Slots of the parts of a vector: character classes, words, repetition.
CLASS_DIMS, WORD_DIMS = 1024, 512
LATENT = 48
SAMPLE_ROWS = 3000
NEIGHBOURS = 15
#: A neighbour's vote is exp((cosine - 1) * SHARPNESS).
SHARPNESS = 12.0
#: Words hardly tell quality beside form, so their part counts less.
WORD_PART, REPEAT_PART = 0.3, 1.0
OUTPUTS = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
_CLASS = np.arange(128, dtype=np.uint32)
_CLASS[ord("a") : ord("z") + 1], _CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("0") : ord("9") + 1] = 97, 65, 48


def _classes(text: str) -> np.ndarray:
    points = code_points(text)
    upper = np.frombuffer(bytes(map(str.isupper, text)), np.uint8) if not text.isascii() else None
    small = _CLASS[np.minimum(points, 127)]
    if upper is not None:
        small = np.where(points < 128, small, np.where(upper, np.uint32(65), np.uint32(97)))
    return small[np.concatenate([[True], small[1:] != small[:-1]])]


def form_counts(text: str) -> np.ndarray | None:
    """Counts of a text's features by slot; None for a blank text."""
    words = text.split()
    if not words:
        return None
    counts = np.zeros(DIMS, np.float32)
    for at in range(0, len(text), PIECE):
        symbols = _classes(text[at : at + PIECE])
        for n in (1, 2, 3, 4):
            counts[:CLASS_DIMS] += np.bincount(n_gram_slots(symbols, n, CLASS_DIMS), minlength=CLASS_DIMS)
    # Words by the classes of their letters and by length and first letters: cheap, and stable between runs.
    lengths = np.minimum(np.fromiter(map(len, words), np.int64, len(words)), 31)
    firsts = np.fromiter((ord(w[0]) * 31 + ord(w[-1]) for w in words), np.int64, len(words))
    counts[CLASS_DIMS : CLASS_DIMS + WORD_DIMS] = np.bincount((firsts * 32 + lengths) * 2654435761 % (1 << 32) >> 23, minlength=WORD_DIMS)
    # How words repeat, as shares of all words in eighths: the same word again, and words seen before.
    again = sum(map(str.__eq__, words[1:], words[:-1])) / len(words)
    seen = 1 - len(set(words)) / len(words)
    at = CLASS_DIMS + WORD_DIMS
    counts[at : at + 16] = round(again * 64)
    counts[at + 16 : at + 32] = round(max(0.0, seen - 0.5) * 64)
    counts[at + 32] = 32
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Vectors of length 1: each part by relative frequency, then the parts together."""
    parts = []
    for low, high, part in (
        (0, CLASS_DIMS, 1.0), (CLASS_DIMS, CLASS_DIMS + WORD_DIMS, WORD_PART), (CLASS_DIMS + WORD_DIMS, DIMS, REPEAT_PART),
    ):
        some = counts[:, low:high]
        total = some.sum(axis=1, keepdims=True)
        parts.append(unit_rows(np.sqrt(some / np.where(total > 0, total, 1)) * idf[low:high]) * np.float32(part))
    return unit_rows(np.concatenate(parts, axis=1))


@dataclass(frozen=True)
class Model:
    """Feature weights, the map to the latent space, and the labelled vectors there."""

    idf: np.ndarray
    projection: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray


def latent_space(x: np.ndarray, rank: int, rounds: int = 3) -> np.ndarray:
    """Columns that span the rank greatest singular directions of x, by subspace iteration."""
    rank = min(rank, *x.shape) if len(x) else 0
    if not rank:
        return np.zeros((x.shape[1], 0), np.float32)
    extra = min(min(x.shape), rank + 16)
    basis = np.linalg.qr(x.T @ (x @ np.random.default_rng(7).standard_normal((x.shape[1], extra)).astype(np.float32)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(x.T @ (x @ basis))[0]
    _, _, turned = np.linalg.svd(x @ basis, full_matrices=False)
    return (basis @ turned[:rank].T).astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality",
    sample_rows: int = SAMPLE_ROWS, rank: int = LATENT,
) -> Model:
    """Learns from the rows of docs; of the labelled ones, a sample of about sample_rows is kept."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("double").alias("label")).where("id IS NOT NULL AND label IS NOT NULL")
    known = known.groupBy("id").agg(F.avg("label").alias("label"))
    rows = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    # Sampled ids are about sample_rows whatever the table; rows of one id share the chance of one row.
    labelled = rows.select("id").join(known, "id").groupBy("id").agg(F.first("label").alias("label"), F.count(F.lit(1)).alias("n"))
    rate = min(1.0, sample_rows / max(1, labelled.count()))
    chosen = labelled.where((F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / float(1 << 30)) < rate).collect()
    kind = f"id {docs.schema[doc_id].dataType.simpleString()}, label double, n long"
    sampled = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], kind)
    joined = rows.join(F.broadcast(sampled), "id", "left")
    taken = F.col("label").isNotNull() & below_rate(1.0 / F.col("n"), "id")
    tagged = joined.withColumn("tag", F.when(taken, F.col("label").cast("string")))
    frequency, n_texts, tags, vectors = learn_pass(tagged, "text", "tag", form_counts, DIMS)
    idf = inverse_frequency(frequency, n_texts)
    x = weighted(vectors, idf)
    projection = latent_space(x, rank)
    return Model(idf, projection, unit_rows(x @ projection), np.array([float(t) for t in tags], np.float64))


def votes(sims: np.ndarray, labels: np.ndarray, neighbours: int = NEIGHBOURS, sharpness: float = SHARPNESS) -> np.ndarray:
    """Mean label of each row's nearest columns, weighted by similarity."""
    k = min(neighbours, sims.shape[1])
    near = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    weights = np.exp((np.take_along_axis(sims, near, axis=1).astype(np.float64) - 1) * sharpness)
    return (weights * labels[near]).sum(axis=1) / weights.sum(axis=1)


def classify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1; higher: label 1 likelier) and predicted (1 from a score of 0.5)."""

    def compute(columns: list[pa.Array]) -> list:
        scores: list[float] = []
        for at in range(0, len(columns[0]), 256):
            counts = [form_counts(t.as_py() or "") for t in columns[0][at : at + 256]]
            block = np.zeros(len(counts))
            known = [i for i, c in enumerate(counts) if c is not None]
            if known and len(model.labels):
                x = unit_rows(weighted(np.array([counts[i] for i in known]), model.idf) @ model.projection)
                block[known] = votes(x @ model.vectors.T, model.labels)
            elif known:
                block[known] = 0.5
            scores.extend(np.clip(block, 0.0, 1.0).round(5).tolist())
        return [scores, [int(s >= 0.5) for s in scores]]

    return with_outputs(docs, [text], OUTPUTS, compute)
