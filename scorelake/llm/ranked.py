"""Ranked lexical search by hashed max-sketches.

A term's weight w is floor(1000 * ln((2N + 2) / (2 df + 1))). A document holding it tf times has the
impact (10^9 tf) div (1000 tf + 12 m), where m = 75 + (25 n N) div L follows from its number of terms n,
the number N of documents with terms, and all their terms L. A score is the sum of w * impact over the
query's terms, repeats included.

Index: one pass counts every text's terms and folds them into a sketch: each term has HASHES coordinates,
and a coordinate holds the greatest tf of its terms (255 stands for any more). As the impact grows with tf
and m is the document's, the impact of a coordinate's tf is the maximum of its terms' impacts; documents
that are added later change N, L and m, but no sketch. Sketches have at least SPARE coordinates a distinct
term, up to WIDEST. Terms and their tf are kept beside the sketch. The same pass counts, by task, how many
documents hold each term.

Search: queries come in blocks of bounded size, every block against all documents. A task looks all terms
of a block up in a batch of sketches at once, each at its least coordinate; a matrix product of the impacts
with the weights gives the upper bound of each document for each query (raised by the product's rounding
error). For each query, the batch's documents are scored exactly in descending order of their bounds until the bound is below the k-th score found. The
k best of each task are merged in two steps, so that no group grows with the number of tasks alone.

Terms are maximal runs of letters, digits and non-ASCII characters; A-Z is lower-cased. Defined cases: a
NULL text has no terms, like an empty one; neither is found, and a query without terms finds nothing. A
query term in no document counts nothing. Scores that are equal go by ascending id, a NULL id last; rows
that repeat an id are documents of their own, each with a rank. Rows of one query id are one query with
the terms of all of them, each different text once; a NULL query id is one query. Texts of any length are
counted whole, in pieces of PIECE bytes. Empty tables give no rows. Other columns are not read.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scorelake.sources.workspace import new_folder

BEST = 20
#: Coordinates of a sketch: SPARE a distinct term, as a power of two in these bounds.
SPARE, NARROWEST, WIDEST = 8, 64, 1 << 17
HASHES = 3
#: Bytes of a text that are split at a time, and distinct terms a task counts before it passes them on.
PIECE, COUNTED = 1 << 22, 1 << 19
#: Terms and queries of a block, about; cells of a matrix of looked-up coordinates.
BLOCK_TERMS, BLOCK_QUERIES, CELLS = 1 << 14, 256, 1 << 21
#: Bytes of an index that a task passes on, and that a writer holds, at a time.
GIVEN, ROW_GROUP = 4 << 20, 32 << 20
#: Bytes of packed tf of the candidates that are kept unpacked.
OPENED = 4 << 20
#: Groups that a query's finds are first merged in.
SEATS = 64
MANY = 255
_DOCUMENT, _TERM = 0, 1
_SEPARATORS = [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_TABLE = bytes.maketrans(
    bytes(_SEPARATORS) + b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b" " * len(_SEPARATORS) + b"abcdefghijklmnopqrstuvwxyz"
)
_PARTS = "kind int, doc_id long, n long, sketch binary, terms binary, tfs binary, term binary, df long"
_TYPES = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
_NAMES = ["kind", "doc_id", "n", "sketch", "terms", "tfs", "term", "df"]


def term_counts(text: str | None) -> Counter:
    """How often each term (UTF-8) occurs in a text."""
    plain = (text or "").encode("utf-8", "surrogatepass").translate(_TABLE)
    counts: Counter = Counter()
    at = 0
    while at < len(plain):
        end = plain.find(b" ", at + PIECE)
        end = len(plain) if end < 0 else end
        counts.update(plain[at:end].split())
        at = end
    return counts


def width_of(distinct: int) -> int:
    return min(WIDEST, max(NARROWEST, 1 << (SPARE * distinct - 1).bit_length()))


def hashes_of(terms) -> np.ndarray:
    """HASHES numbers of 32 bits per term, a row for each; their low bits are coordinates."""
    first = np.fromiter(map(zlib.crc32, terms), np.uint32, len(terms))
    mixed = (first ^ (first >> np.uint32(15))) * np.uint32(0x9E3779B1)
    step = (mixed ^ (mixed >> np.uint32(16))) | np.uint32(1)
    return first + np.arange(HASHES, dtype=np.uint32)[:, None] * step


def sketch_of(terms: list[bytes], tfs: np.ndarray) -> np.ndarray:
    """The greatest tf at each coordinate."""
    width = width_of(len(terms))
    sketch = np.zeros(width, np.uint8)
    held = np.minimum(tfs, MANY).astype(np.uint8)
    for row in hashes_of(terms) & np.uint32(width - 1):
        np.maximum.at(sketch, row, held)
    return sketch


def build_index(docs: DataFrame, folder: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Writes the index of docs to a new folder and returns it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holding: Counter = Counter()
        for batch in batches:
            made: list[tuple] = []
            held = 0
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                counts = term_counts(value.as_py())
                if not counts:
                    continue
                terms = list(counts)
                tfs = np.fromiter(counts.values(), "<u4", len(terms))
                holding.update(terms)
                made.append((key.as_py(), int(tfs.sum()), sketch_of(terms, tfs).tobytes(), b" ".join(terms), tfs.tobytes()))
                held += len(made[-1][2]) + len(made[-1][3]) + len(made[-1][4])
                if held > GIVEN:
                    yield _documents(made)
                    made, held = [], 0
            yield _documents(made)
            if len(holding) > COUNTED:
                yield _terms(holding)
                holding.clear()
        yield _terms(holding)

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows.mapInArrow(run, _PARTS).write.option("parquet.block.size", ROW_GROUP).parquet(folder)
    return docs.sparkSession.read.parquet(folder)


def _batch(columns: list[list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES, strict=True)], names=_NAMES)


def _documents(made: list[tuple]) -> pa.RecordBatch:
    none = [None] * len(made)
    return _batch([[_DOCUMENT] * len(made), *([r[i] for r in made] for i in range(5)), none, none])


def _terms(holding: Counter) -> pa.RecordBatch:
    none = [None] * len(holding)
    return _batch([[_TERM] * len(holding), none, none, none, none, none, list(holding), list(holding.values())])


def query_terms(queries: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, term and its number of occurrences in the query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                counts = term_counts(value.as_py())
                yield pa.RecordBatch.from_arrays(
                    [pa.array([key] * len(counts), pa.int64()), pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                    names=["item_id", "term", "times"],
                )

    rows = queries.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text")).distinct()
    return rows.mapInArrow(run, "item_id long, term binary, times long").groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def impact(tf: int, m: int) -> int:
    return 1_000_000_000 * tf // (1000 * tf + 12 * m)


@dataclass
class Block:
    """Queries that are looked up together: their ids, and the weights of their terms as lists and as a matrix."""

    items: list[int | None]
    terms: list[list[tuple[bytes, int]]]
    hashes: np.ndarray
    matrix: np.ndarray

    @staticmethod
    def of(rows: list, documents: int) -> Block:
        """rows: item_id, term, times, df."""
        by_item: dict[int | None, list[tuple[bytes, int]]] = {}
        for r in rows:
            w = math.floor(1000 * math.log((2 * documents + 2) / (2 * r.df + 1)))
            if w > 0:
                by_item.setdefault(r.item_id, []).append((bytes(r.term), w * r.times))
        items = list(by_item)
        vocabulary = {t: i for i, t in enumerate(sorted({t for terms in by_item.values() for t, _ in terms}))}
        matrix = np.zeros((len(vocabulary), len(items)), np.float32)
        for j, item in enumerate(items):
            for t, w in by_item[item]:
                matrix[vocabulary[t], j] = w
        return Block(items, [by_item[i] for i in items], hashes_of(list(vocabulary)), matrix)

    def bounds(self, sketches: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores: a row per sketch (all of one width), a column per query."""
        slots = self.hashes & np.uint32(sketches.shape[1] - 1)
        held = sketches[:, slots[0]]
        for row in slots[1:]:
            np.minimum(held, sketches[:, row], out=held)
        tf = _TF[held]
        impacts = np.float32(1e6) * tf / (tf + np.float32(0.012) * m[:, None].astype(np.float32))
        rounding = 1 + (len(self.matrix) + 16) * 2.0**-23
        return (impacts @ self.matrix).astype(np.float64) * rounding


_TF = np.arange(MANY + 1, dtype=np.float32)
_TF[MANY] = 1e12


class _Document:
    """A candidate's terms, unpacked when it is first scored."""

    def __init__(self, terms: bytes, tfs: bytes, m: int) -> None:
        self.tf = dict(zip(terms.split(b" "), np.frombuffer(tfs, "<u4").tolist(), strict=True))
        self.m = m

    def score(self, weighted: list[tuple[bytes, int]]) -> int:
        get = self.tf.get
        return sum(w * impact(tf, self.m) for t, w in weighted if (tf := get(t)))


def _finds(block: Block, documents: int, length: int, best: int):
    """The best scores of each query among a task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: list[list[tuple[int, float, int]]] = [[] for _ in block.items]
        rows = max(1, CELLS // len(block.matrix))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            m = np.array([75 + 25 * n * documents // length for n in batch.column(1).to_pylist()], np.float64)
            widths = np.array([len(s.as_buffer()) for s in batch.column(2)], np.int64)
            bounds = np.zeros((len(ids), len(block.items)))
            for width in np.unique(widths):
                same = np.flatnonzero(widths == width)
                for at in range(0, len(same), rows):
                    part = same[at : at + rows]
                    sketches = np.frombuffer(b"".join(batch.column(2)[int(i)].as_py() for i in part), np.uint8).reshape(len(part), -1)
                    bounds[part] = block.bounds(sketches, m[part])
            _rescore(block, heaps, bounds, ids, m, batch, best)
        out = [(item, key[2], key[0]) for item, heap in zip(block.items, heaps, strict=True) for key in heap]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in out], pa.int64()), pa.array([None if r[1] == -_NO_ID else -r[1] for r in out], pa.int64()),
             pa.array([r[2] for r in out], pa.int64())],
            names=["item_id", "doc_id", "score"],
        )

    return run


_NO_ID = 1 << 70


def _rescore(block: Block, heaps: list, bounds: np.ndarray, ids: list, m: np.ndarray, batch: pa.RecordBatch, best: int) -> None:
    opened: dict[int, _Document] = {}
    held = 0
    for j, (heap, weighted) in enumerate(zip(heaps, block.terms, strict=True)):
        column = bounds[:, j]
        least = heap[0][0] if len(heap) == best else 1
        hopeful = np.flatnonzero(column >= least)
        for row in hopeful[np.argsort(-column[hopeful], kind="stable")].tolist():
            if len(heap) == best and column[row] < heap[0][0]:
                break
            if row not in opened:
                held += len(batch.column(4)[row].as_buffer())
                if held > OPENED:
                    opened.clear()
                    held = 0
                opened[row] = _Document(batch.column(3)[row].as_py(), batch.column(4)[row].as_py(), int(m[row]))
            score = opened[row].score(weighted)
            if score <= 0:
                continue
            # Greater scores are better, then smaller ids; a NULL id is after all others.
            key = (score, 0, -(_NO_ID if ids[row] is None else ids[row]))
            if len(heap) < best:
                heapq.heappush(heap, key)
            elif key > heap[0]:
                heapq.heapreplace(heap, key)


def _ranked(finds: DataFrame, best: int) -> DataFrame:
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    seat = F.pmod(F.xxhash64("doc_id", F.spark_partition_id()), F.lit(SEATS))
    some = finds.withColumn("seat", seat).withColumn("rank", F.row_number().over(Window.partitionBy("item_id", "seat").orderBy(*order)))
    some = some.where(F.col("rank") <= best).drop("rank", "seat")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order)))
    return ranked.where(F.col("rank") <= best).select("item_id", "rank", "doc_id", "score")


def search(
    index: DataFrame, queries: DataFrame, best: int = BEST, item_id: str = "item_id", text: str = "text",
    block_terms: int = BLOCK_TERMS, block_queries: int = BLOCK_QUERIES,
) -> DataFrame:
    """item_id, rank (from 1), doc_id and score: the best documents of an index for each query."""
    spark = index.sparkSession
    documents = index.where(F.col("kind") == _DOCUMENT).select("doc_id", "n", "sketch", "terms", "tfs")
    count, length = documents.agg(F.count(F.lit(1)), F.sum("n")).first()
    asked = _written(query_terms(queries, item_id, text), "asked")
    size = asked.agg(F.count(F.lit(1)).alias("terms"), F.count_distinct(F.struct("item_id")).alias("items")).first()
    finds = spark.createDataFrame([], "item_id long, doc_id long, score long")
    if not count or not size.items:
        return _ranked(finds, best)
    blocks = max(math.ceil(size.terms / block_terms), math.ceil(size.items / block_queries))
    number = F.pmod(F.xxhash64("item_id"), F.lit(blocks))
    counts = index.where(F.col("kind") == _TERM).select("term", "df")
    for b in range(blocks):
        here = asked.where(number == b)
        df = counts.join(here.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("df").alias("df"))
        block = Block.of(here.join(df, "term").collect(), count)
        if block.items:
            found = documents.mapInArrow(_sent(spark, block, count, length, best), "item_id long, doc_id long, score long")
            finds = finds.unionByName(found)
    return _ranked(finds, best)


def _sent(spark, block: Block, count: int, length: int, best: int):
    shared = spark.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _finds(shared.value, count, length, best)(batches)

    return run


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)
