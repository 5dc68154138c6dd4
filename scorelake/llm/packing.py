"""Best-fit packing of documents into sequences of several permitted lengths.

A sequence of length c costs overhead + c * (1 + c / attention): a fixed part, its tokens, and what
attention adds with length. Documents longer than the greatest length are cut into pieces of that
length and a rest. Pieces are taken longest first; each goes to the open bin with the least room
that is enough. Where none is, a bin is opened whose length gives the least cost per token it can
still receive (the piece and everything not yet placed), over all permitted lengths together. At
the end each bin shrinks to the least permitted length that holds its contents.

Documents are dealt by hash into shards of a bounded number of rows, and each shard is packed by
itself, so memory is bounded and tasks are alike whatever the table. Only ids and lengths travel.

Defined cases: a document without tokens (NULL or empty) gives one row with no bin; repeated rows
are numbered by copy from 0 among rows of equal doc_id and length, and copies are spread over the
shards; a NULL doc_id is an id like another. Other columns are not read.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.llm.common import words_of

LENGTHS = (512, 1024, 2048, 4096, 8192)
OVERHEAD = 256.0
ATTENTION = 16384.0
#: Documents that are packed together, about.
SHARD_ROWS = 4096
_PLACED = "doc_id {}, copy long, piece int, start long, n_tokens long, bin_id string, bin_length int, bin_offset int"


def cost(length: int, overhead: float = OVERHEAD, attention: float = ATTENTION) -> float:
    return overhead + length * (1 + length / attention)


def opened(piece: int, left: int, lengths: tuple[int, ...], overhead: float, attention: float) -> int:
    """The length to open for a piece when left tokens, its own included, are not placed yet."""
    fitting = [c for c in lengths if c >= piece]
    return min(fitting, key=lambda c: (cost(c, overhead, attention) / min(c, left), c))


def pack_pieces(pieces: list[int], lengths: tuple[int, ...], overhead: float = OVERHEAD, attention: float = ATTENTION):
    """Bins for pieces in descending length: (bin of each piece, offset of each piece, length of each bin)."""
    room: list[int] = []  # of open bins, by value; bins of equal room in the order they came to it
    bins_of: defaultdict[int, list[int]] = defaultdict(list)
    where, offsets, sizes, used = [], [], [], []
    left = sum(pieces)
    for n in pieces:
        at = bisect_left(room, n)
        if at == len(room):
            b, have = len(sizes), opened(n, left, lengths, overhead, attention)
            sizes.append(have)
            used.append(0)
        else:
            have = room[at]
            b = bins_of[have].pop(0)
            if not bins_of[have]:
                del bins_of[have]
                room.pop(at)
        where.append(b)
        offsets.append(used[b])
        used[b] += n
        left -= n
        if have > n:
            if have - n not in bins_of:
                insort(room, have - n)
            bins_of[have - n].append(b)
    return where, offsets, [min(c for c in lengths if c >= u) for u in used]


def _pack_shard(lengths: tuple[int, ...], overhead: float, attention: float):
    longest = max(lengths)

    def pack(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(
            zip(*(table.column(c).to_pylist() for c in ("doc_id", "copy", "n_tokens")), strict=True),
            key=lambda r: (-r[2], r[0] is not None, r[0] if r[0] is not None else 0, r[1]),
        )
        pieces = [
            (min(longest, n - at), doc_id, copy, at // longest, at)
            for doc_id, copy, n in rows
            for at in range(0, n, longest)
        ]
        pieces.sort(key=lambda p: -p[0])  # stable
        where, offsets, sizes = pack_pieces([p[0] for p in pieces], lengths, overhead, attention)
        shard = key[0].as_py()
        names = [f"{shard}-{b}" for b in where]
        out = {
            "doc_id": pa.array([p[1] for p in pieces], table.schema.field("doc_id").type),
            "copy": pa.array([p[2] for p in pieces], pa.int64()),
            "piece": pa.array([p[3] for p in pieces], pa.int32()),
            "start": pa.array([p[4] for p in pieces], pa.int64()),
            "n_tokens": pa.array([p[0] for p in pieces], pa.int64()),
            "bin_id": pa.array(names, pa.string()),
            "bin_length": pa.array([sizes[b] for b in where], pa.int32()),
            "bin_offset": pa.array(offsets, pa.int32()),
        }
        return pa.table(out)

    return pack


def pack(
    docs: DataFrame,
    lengths: tuple[int, ...] = LENGTHS,
    overhead: float = OVERHEAD,
    attention: float = ATTENTION,
    shard_rows: int = SHARD_ROWS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """A row per piece: doc_id, copy, piece, start and n_tokens in the document, bin_id, bin_length, bin_offset.

    Tokens are words; start counts them from 0.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.size(words_of(F.col(text))).cast("long").alias("n_tokens"))
    items = rows.groupBy("doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("n"))
    items = items.select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("copy"))
    shards = max(1, math.ceil(docs.select(F.count(F.lit(1))).first()[0] / shard_rows))
    dealt = items.withColumn("shard", F.pmod(F.xxhash64("doc_id", "copy"), F.lit(shards)))
    kind = docs.schema[doc_id].dataType.simpleString()
    packed = (
        dealt.where("n_tokens > 0").groupBy("shard").applyInArrow(_pack_shard(tuple(sorted(lengths)), overhead, attention), _PLACED.format(kind))
    )
    nothing = items.where("n_tokens = 0").select(
        "doc_id", "copy", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), "n_tokens",
        F.lit(None).cast("string").alias("bin_id"), F.lit(None).cast("int").alias("bin_length"), F.lit(None).cast("int").alias("bin_offset"),
    )
    return packed.unionByName(nothing)
