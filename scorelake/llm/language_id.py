"""Language identification by nearest centroid.

A text becomes a vector of hashed runs of one to three letters (lower-cased; everything else is a
boundary), weighted by log frequency and inverse document frequency, with length 1. Each language
has several centroids, found by spherical k-means among its training vectors. A text has the
language of the centroid of greatest cosine. It is rejected if that cosine is below the floor for texts
of its length: a part of the low quantile of the cosines that sampled texts of about that length have, which
were held out from the centroids. Short texts hold few runs, so their floors are lower.

Document frequencies come from all training texts. Centroids are fitted on different texts of a bounded sample,
SAMPLE_ROWS texts in all, the same number for each language as far as it has them.

Defined cases: a text that is NULL or holds no letter gets `und`, score 0 and is rejected, as does
every text if nothing could be learned. Rows without a language or a letter teach nothing.
Repeated rows get equal results; of centroids at equal cosines the first by language counts. Texts of any length
are hashed whole, in pieces of PIECE code points, so memory is bounded by the text and its vector. A column of docs that has an output's name is replaced.
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
    PIECE, below_rate, code_points, counted, inverse_frequency, learn_pass, n_gram_slots, unit_rows,
)

DIMS = 4096
SAMPLE_ROWS = 4096
CENTROIDS = 4
ROUNDS = 12
#: The floor of a length is this part of the low quantile of held-out cosines around it, of at least so many texts;
#: below the least such length it falls by SHORTER with each halving.
FLOOR_PART, FLOOR_QUANTILE, FLOOR_TEXTS, SHORTER = 0.7, 0.005, 20, 0.75
#: Cosines are turned into scores over languages at this scale.
SHARPNESS = 24.0
UNKNOWN = "und"
OUTPUTS = T.StructType(
    [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
     T.StructField("similarity", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
)
# Letters as they are, everything else in ASCII one boundary; outside ASCII only spaces and punctuation blocks are.
_ASCII = np.array([c if chr(c).isalpha() else 32 for c in range(128)], np.uint32)


def letter_counts(text: str) -> np.ndarray | None:
    """Counts of a text's letter runs by slot; None if it has no letter (Unicode category L)."""
    if not any(map(str.isalpha, text)):
        return None

    def slots():
        text_ = text.lower()
        for at in range(0, len(text_), PIECE):
            points = code_points(text_[at : at + PIECE + 2])
            outside = np.where((points >= 0x2000) & (points < 0x2070) | (points < 0xC0), np.uint32(32), points)
            symbols = np.where(points < 128, _ASCII[np.minimum(points, 127)], outside)
            gap = symbols == 32
            symbols = symbols[~(gap & np.concatenate([[False], gap[:-1]]))]
            for n in (1, 2, 3):
                yield n_gram_slots(symbols, n, DIMS)

    return counted(slots(), DIMS)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    return unit_rows(np.log1p(counts) * idf)


@dataclass(frozen=True)
class Model:
    """Centroids by row and the language of each; lengths (as logarithms) and the floors at them."""

    idf: np.ndarray
    centroids: np.ndarray
    languages: list[str]
    lengths: np.ndarray
    floors: np.ndarray

    def floor(self, counts: np.ndarray) -> np.ndarray:
        """The least cosine that texts with these counts (by row) are accepted at."""
        if not len(self.lengths):
            return np.zeros(len(counts))
        length = np.log2(counts.sum(axis=1))
        short = np.maximum(0, self.lengths[0] - length)
        return np.interp(length, self.lengths, self.floors) * SHORTER**short


def _floors(lengths: np.ndarray, cosines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Floors of held-out texts at whole logarithms of their lengths, as far as there are enough texts around."""
    at, floors = [], []
    for step in np.unique(np.round(lengths)) if len(lengths) else ():
        near = cosines[np.abs(lengths - step) <= 1]
        if len(near) >= FLOOR_TEXTS:
            at.append(float(step))
            floors.append(FLOOR_PART * float(np.quantile(near, FLOOR_QUANTILE)))
    if not at and len(lengths):
        at, floors = [float(np.median(lengths))], [FLOOR_PART * float(np.quantile(cosines, FLOOR_QUANTILE))]
    return np.array(at), np.array(floors)


def clustered(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Spherical k-means; starts from rows drawn in proportion to their squared distance from those drawn."""
    rng = np.random.default_rng(7)
    chosen = [x[int(np.argmax(x @ unit_rows(x.mean(axis=0))))]]
    while len(chosen) < min(k, len(x)):
        far = np.clip(1 - (x @ np.array(chosen).T).max(axis=1), 0, None).astype(np.float64) ** 2
        if far.sum() <= 1e-9:
            break
        chosen.append(x[int(rng.choice(len(x), p=far / far.sum()))])
    centroids = np.array(chosen)
    for _ in range(rounds):
        nearest = (x @ centroids.T).argmax(axis=1)
        centroids = np.array(
            [unit_rows(x[nearest == i].mean(axis=0)) if (nearest == i).any() else centroids[i] for i in range(len(centroids))]
        )
    return centroids


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", sample_rows: int = SAMPLE_ROWS, centroids: int = CENTROIDS) -> Model:
    """Learns from every row of docs that has a language and a letter."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang")).where("lang IS NOT NULL")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    share = sample_rows / max(1, len(counts))
    rate = F.lit(0.0)
    for language, n in counts.items():
        rate = F.when(F.col("lang") == language, F.lit(min(1.0, share / n))).otherwise(rate)
    tagged = rows.withColumn("tag", F.when(below_rate(rate, "text"), F.col("lang")))
    frequency, n, tags, vectors = learn_pass(tagged, "text", "tag", letter_counts, DIMS)
    idf = inverse_frequency(frequency, n)
    names = np.array(tags, object)
    found, languages, lengths, cosines = [], [], [], []
    for language in sorted(set(tags)):
        own = np.unique(vectors[names == language], axis=0)
        held = np.arange(len(own)) % 4 == 3 if len(own) >= 8 else np.ones(len(own), bool)
        x = weighted(own, idf)
        means = clustered(x[~held] if len(own) >= 8 else x, centroids)
        found.extend(means)
        languages += [language] * len(means)
        lengths.append(np.log2(own[held].sum(axis=1)))
        cosines.append((x[held] @ means.T).max(axis=1))
    joined = [np.concatenate(v) if v else np.empty(0) for v in (lengths, cosines)]
    return Model(idf, np.array(found, np.float32).reshape(len(found), DIMS), languages, *_floors(*joined))


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1), similarity (cosine) and rejected."""
    languages = sorted(set(model.languages))
    of_language = np.array([languages.index(x) for x in model.languages], int)

    def compute(columns: list[pa.Array]) -> list:
        preds, scores, cosines, rejected = [], [], [], []
        texts = columns[0]
        for at in range(0, len(texts), 256):
            counts = [letter_counts(t.as_py()) if t.is_valid else None for t in texts[at : at + 256]]
            known = [i for i, c in enumerate(counts) if c is not None and languages]
            block: list[tuple] = [(UNKNOWN, 0.0, 0.0, True)] * len(counts)
            if known:
                held = np.array([counts[i] for i in known])
                x, floors = weighted(held, model.idf), model.floor(held)
                sims = x @ model.centroids.T
                best = sims.argmax(axis=1)
                by_language = np.stack([sims[:, of_language == j].max(axis=1) for j in range(len(languages))], axis=1)
                odds = np.exp(SHARPNESS * (by_language - by_language.max(axis=1, keepdims=True)).astype(np.float64))
                for i, row, b, odd, floor in zip(known, sims, best, odds, floors, strict=True):
                    block[i] = (
                        model.languages[b], round(min(1.0, float(1.0 / odd.sum())), 6), round(float(row[b]), 5), bool(row[b] < floor)
                    )
            for out, values in zip((preds, scores, cosines, rejected), zip(*block, strict=True), strict=True):
                out.extend(values)
        return [preds, scores, cosines, rejected]

    return with_outputs(docs, [text], OUTPUTS, compute)
