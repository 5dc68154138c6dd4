"""Exact nearest neighbours by cosine as a block matrix join.

Unit vectors are quantised to int8 with one scale per vector. Queries and candidates are cut into
blocks, every pair of blocks meets once in a grid, and the product of two int8 blocks gives each
cosine with an error bound: for x = a*p + e and y = b*q + f (p, q the int8 vectors),
|x.y - a*b*(p.q)| <= |e|*|y| + |a*p|*|f|. Only pairs whose upper bound reaches the k-th best lower
bound of their query in the tile are computed again from the original vectors in double precision.
The best k of each tile are then merged by heaps, so the result is the exact one.

Each candidate is sent once per query block and each query once per candidate block. Block sizes
are parameters; nothing else depends on them. A block's rows are also bounded by its components, so
a task's memory does not grow with the dimension until one vector alone is longer than a block.

Defined cases: rows with a NULL id, and vectors that are NULL, empty, zero or hold NULL or
non-finite components, take no part; nor do pairs of different dimension. Repeated rows (equal id
and vector) count once; different vectors of one id are each candidates under that id, and as
queries the smallest such vector stands for the id. Equal cosines are ranked by smaller id. A query
is never its own neighbour, whatever vector.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block at most, and components of a block at most: long vectors make blocks of fewer rows.
QUERY_BLOCK, QUERY_VALUES = 16384, 1 << 23
CANDIDATE_BLOCK, CANDIDATE_VALUES = 2048, 1 << 21
#: Rows of a query block whose products are in memory at a time.
STRIP = 512
#: More than any rounding error of the bounds themselves, which are computed in single precision.
SLACK = 1e-5

_FOUND = "query_id long, vec_id long, score double"


def usable(vector: Column) -> Column:
    """True for vectors with a direction."""
    values = vector.cast("array<double>")
    finite = F.forall(
        values, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    )
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(values, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    """A row per list of a column of equally long lists without NULLs."""
    flat = [chunk.flatten().cast(pa.float64(), safe=False).to_numpy(zero_copy_only=False) for chunk in column.chunks]
    return np.concatenate(flat).reshape(len(column), -1)


def _quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """int8 vectors (held as float32, in which their products are exact), scales, |e| and |a*p|."""
    big = np.abs(x).max(axis=1, keepdims=True)
    unit = x / big
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    scale = np.abs(unit).max(axis=1, keepdims=True) / 127.0
    whole = np.rint(unit / scale).astype(np.int8)
    kept = whole * scale
    error = np.sqrt(((unit - kept) ** 2).sum(axis=1))
    return whole.astype(np.float32), scale[:, 0], error, np.sqrt((kept * kept).sum(axis=1))


def _ordered_sum(x: np.ndarray) -> np.ndarray:
    """Row sums, added from the first to the last component."""
    return np.cumsum(x, axis=1)[:, -1]


def _exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows in double precision."""
    with np.errstate(over="ignore", invalid="ignore"):
        norms = np.sqrt(_ordered_sum(x * x)) * np.sqrt(_ordered_sum(y * y))
        dots = _ordered_sum(x * y) / norms
    odd = ~np.isfinite(dots) | (norms == 0)
    if odd.any():  # components so large or small that squares leave the range of doubles
        a, b = (v[odd] / np.abs(v[odd]).max(axis=1, keepdims=True) for v in (x, y))
        dots[odd] = _ordered_sum(a * b) / (np.sqrt(_ordered_sum(a * a)) * np.sqrt(_ordered_sum(b * b)))
    return np.clip(dots, -1.0, 1.0)


def _tile(q_ids: np.ndarray, q: np.ndarray, c_ids: np.ndarray, c: np.ndarray, k: int) -> Iterator[tuple]:
    """The k best candidates of each query within two blocks: (query ids, candidate ids, cosines) by strip."""
    qw, qs, qe, qn = _quantised(q)
    cw, cs, ce, cn = _quantised(c)
    dims = range(0, q.shape[1], 1024)  # sums of that many int8 products are exact in single precision
    for at in range(0, len(q), STRIP):
        part = slice(at, at + STRIP)
        product = sum(
            (qw[part, d : d + 1024] @ cw[:, d : d + 1024].T).astype(np.float64) for d in dims
        ) * (qs[part, None] * cs[None, :])
        bound = qe[part, None] * 1.0 + qn[part, None] * ce[None, :] + SLACK
        own = q_ids[part, None] == c_ids[None, :]
        low = np.where(own, -np.inf, product - bound)
        kth = np.partition(low, -k, axis=1)[:, -k] if low.shape[1] > k else np.full(len(low), -np.inf)
        rows, cols = np.nonzero((product + bound >= kth[:, None]) & ~own)
        # Survivors are recomputed a slice at a time: with many equal vectors they can be whole rows.
        step = max(1, 1 << 22 >> max(0, int(q.shape[1] - 1).bit_length()))
        scores = np.concatenate(
            [np.empty(0), *(_exact(q[part][rows[i : i + step]], c[cols[i : i + step]]) for i in range(0, len(rows), step))]
        )
        order = np.lexsort((c_ids[cols], -scores, rows))
        rows, cols, scores = rows[order], cols[order], scores[order]
        place = np.arange(len(rows)) - np.searchsorted(rows, rows)
        best = place < k
        yield q_ids[part][rows[best]], c_ids[cols[best]], scores[best]


def _join_tiles(k: int):
    def join(key, left: pa.Table, right: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            q_ids, c_ids = (t.column("id").to_numpy() for t in (left, right))
            q, c = _matrix(left.column("v")), _matrix(right.column("v"))
            found = list(_tile(q_ids, q, c_ids, c, k))
        columns = [np.concatenate([x[i] for x in found]) if found else [] for i in range(3)]
        return pa.table(
            {n: pa.array(v, t) for n, v, t in zip(("query_id", "vec_id", "score"), columns, (pa.int64(), pa.int64(), pa.float64()), strict=True)}
        )

    return join


def _merge_heaps(k: int):
    """Keeps the k best of each query among rows that lie together."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heaps: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for query, vec, score in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                heap = heaps.setdefault(query, [])
                item = (score, -vec)
                if item in heap:
                    continue
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
        ids, ranks, vecs, scores = [], [], [], []
        for query, heap in heaps.items():
            for rank, (score, vec) in enumerate(sorted(heap, reverse=True), 1):
                ids.append(query)
                ranks.append(rank)
                vecs.append(-vec)
                scores.append(score)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(ranks, pa.int32()), pa.array(vecs, pa.int64()), pa.array(scores, pa.float64())],
            names=["query_id", "rank", "vec_id", "score"],
        )

    return merge


def nearest(
    queries: DataFrame,
    candidates: DataFrame,
    k: int = 5,
    id_column: str = "vec_id",
    vector: str = "embedding",
    query_block: int = QUERY_BLOCK,
    candidate_block: int = CANDIDATE_BLOCK,
) -> DataFrame:
    """The k nearest candidates of each query: query_id, rank (from 1), vec_id, score (cosine).

    Other columns are not read.
    """

    def prepared(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(id_column).cast("long").alias("id"), F.col(vector).alias("v"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))

    q, c = prepared(queries), prepared(candidates)
    n_q, n_c = (df.select(F.count(F.lit(1))).first()[0] for df in (q, c))
    def blocks(n: int, rows: int, values: int) -> Column:
        """Blocks of the vectors of a row's dimension, as if all n had it."""
        held = F.least(F.lit(rows), F.greatest(F.lit(1), F.floor(F.lit(values) / F.col("dim"))))
        return F.greatest(F.lit(1), F.ceil(F.lit(n) / held)).cast("long")

    q_blocks, c_blocks = blocks(n_q, query_block, QUERY_VALUES), blocks(n_c, candidate_block, CANDIDATE_VALUES)
    slot = F.xxhash64("id", "v")
    q = q.groupBy("id").agg(F.min_by(F.struct("v", "dim"), F.struct("dim", "v")).alias("x")).select("id", "x.*")
    q = q.withColumn("r", F.pmod(slot, q_blocks)).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), c_blocks - 1)))
    # Repeated rows meet before they are dealt out, so a tile never gets many of one.
    c = c.groupBy("id", "v", "dim").agg(F.count(F.lit(1)).alias("n")).drop("n")
    c = c.withColumn("c", F.pmod(slot, c_blocks)).withColumn(
        "r", F.explode(F.sequence(F.lit(0).cast("long"), q_blocks - 1))
    )
    keys = ("dim", "r", "c")
    tiles = q.groupBy(*keys).cogroup(c.groupBy(*keys)).applyInArrow(_join_tiles(k), _FOUND)
    return tiles.repartition("query_id").mapInArrow(_merge_heaps(k), "query_id long, rank int, vec_id long, score double")
