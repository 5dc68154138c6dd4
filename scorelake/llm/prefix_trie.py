"""The trie of conversation prefixes, by union-find over the edges between sorted neighbours.

Conversations are sequences of turns; each distinct sequence of first d turns is a node. A turn is a key
of 16 bytes (md5 of its role and text) and its text's length; a conversation is one row of keys. Rows are
sorted by their keys and then by id, a range partition per task, so that a group of equal conversations
spreads over tasks. Neighbours have an edge of the depth of their longest common prefix.

A task takes its rows in blocks. In a block, edges are taken in descending depth and their rows merged by
union-find: what has merged before an edge of depth d is complete below d, so its chain of nodes down to
d + 1 is given out, and the merged component is a branching node at d. Nodes that hold neither the first
nor the last row of a block are final. The others, prefixes of these two rows, are the block's contracted
forest: its sums per open node.

Open nodes of all blocks are merged by their prefix's hash. All that a node needs is a sum over its rows,
where a row is compared with the one before it only: rows; leaves (the row is no prefix of the next);
children (the common prefix with the row before ends here); and the turns shared with the row before,
which give the tokens saved. What a block's first row shares with the row before, and whether its last row
is a leaf, follow from the open nodes that two blocks have in common, and are added before the merge.
Final nodes below an open one get its name by a join on block and prefix, which no hot prefix collects.

Ids of conversations that end at a final node are hashed in its block. Those of open nodes come as one
text per block, and one task hashes a node's texts in order as they stream by.

Defined cases: a NULL role or text is empty; a NULL turn comes first; turns of one number go by their
keys, and repeated rows are turns of their own; rows without a conversation id take no part. Texts of any
length are hashed where they are read. A conversation is one row of 24 bytes a turn. An empty table has no
nodes, not even a root. Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake.sources.workspace import new_folder

#: Conversations of a block, and bytes of their keys.
BLOCK, BLOCK_BYTES = 1 << 14, 64 << 20
KEY = 16
_EMPTY = hashlib.sha256(b"").hexdigest()
_FINAL, _OPEN, _ENDS = 0, 1, 2
#: One table for what a block gives: final nodes, open nodes, and ids that end at open nodes.
_FIELDS = (
    ("kind", "int", pa.int32()), ("block", "long", pa.int64()), ("conv_id", "long", pa.int64()), ("depth", "long", pa.int64()),
    ("parent_conv_id", "long", pa.int64()), ("n_convs", "long", pa.int64()), ("n_children", "long", pa.int64()),
    ("n_leaves", "long", pa.int64()), ("saved", "long", pa.int64()), ("ends", "string", pa.string()),
    ("node", "binary", pa.binary()), ("parent", "binary", pa.binary()), ("before", "long", pa.int64()),
    ("upto", "long", pa.int64()), ("first_depth", "long", pa.int64()), ("last_depth", "long", pa.int64()),
)
_SCHEMA = ", ".join(f"{name} {kind}" for name, kind, _ in _FIELDS)


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id and turns: an array of (key, chars) in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    turn = F.struct(F.col("turn").isNotNull().alias("numbered"), "turn", key.alias("key"), F.length(text).alias("chars"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return grouped.select("conv_id", F.transform("t", lambda t: F.struct(t["key"].alias("key"), t["chars"].cast("long").alias("chars"))).alias("turns"))


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Each conversation after the first h turns of its group's first one; h is a checksum of the id, below most.

    A group is every ids from a multiple of it on; where its first conversation is absent, nothing is put before.
    """
    root = F.col("conv_id") - F.col("conv_id") % every
    heads = turns.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("root"), F.slice("turns", 1, max(1, most - 1)).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    joined = turns.withColumn("root", root).withColumn("h", h).join(heads, "root", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    own = F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))
    return joined.select("conv_id", F.concat(head, own).alias("turns"))


def _common(a: bytes, b: bytes) -> int:
    """Turns that two sequences of keys have in common at their start."""
    low, high = 0, min(len(a), len(b)) // KEY
    while low < high:
        middle = (low + high + 1) // 2
        if a[low * KEY : middle * KEY] == b[low * KEY : middle * KEY]:
            low = middle
        else:
            high = middle - 1
    return low


def _path(keys: bytes) -> list[bytes]:
    """Hashes of all prefixes of a sequence, the empty one first."""
    chain = hashlib.md5()
    hashes = [chain.digest()]
    for at in range(0, len(keys), KEY):
        chain.update(keys[at : at + KEY])
        hashes.append(chain.copy().digest())
    return hashes


class Forest:
    """The nodes of a block of sorted rows (keys, chars, conv_id)."""

    def __init__(self, block: int, rows: list[tuple[bytes, list[int], int]]) -> None:
        self.block, self.rows, self.n = block, rows, len(rows)
        self.depth = [len(keys) // KEY for keys, _, _ in rows]
        self.chars = [[0, *accumulate(chars)] for _, chars, _ in rows]
        self.shared = [0, *(_common(rows[i - 1][0], rows[i][0]) for i in range(1, self.n))]
        self.paths = (_path(rows[0][0]), _path(rows[-1][0]))
        self.same = self._runs()
        # Of a component, kept at its root: first and last row, depth of its top node, that node's children,
        # least id, leaves, turns shared with the rows before, and final nodes whose parent is the top node.
        self.up = list(range(self.n))
        self.low, self.high, self.top = list(range(self.n)), list(range(self.n)), list(self.depth)
        self.children, self.least = [0] * self.n, [conv_id for _, _, conv_id in rows]
        self.leaves = [int(i + 1 < self.n and self.shared[i + 1] < self.depth[i]) for i in range(self.n)]
        self.saved, self.waiting = [0] * self.n, [[] for _ in range(self.n)]
        self.out: list[list] = []

    def _runs(self) -> list[int]:
        """The row after the last one that equals each row."""
        after = [self.n] * self.n
        for i in range(self.n - 2, -1, -1):
            equal = self.shared[i + 1] == self.depth[i] == self.depth[i + 1]
            after[i] = after[i + 1] if equal else i + 1
        return after

    def _root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def build(self) -> list[list]:
        for i in sorted(range(1, self.n), key=lambda i: -self.shared[i]):
            self._merge(self._root(i - 1), self._root(i), i)
        self._give(self._root(0), -1)
        return self.out

    def _merge(self, a: int, b: int, edge: int) -> None:
        d = self.shared[edge]
        for x in (a, b):
            if self.top[x] > d:
                self._give(x, d)
        if self.high[a] - self.low[a] < self.high[b] - self.low[b]:
            big, small = b, a
        else:
            big, small = a, b
        self.up[small] = big
        low, high = self.low[a], self.high[b]
        self.low[big], self.high[big] = low, high
        self.children[big] += self.children[small]
        self.leaves[big] += self.leaves[small]
        self.saved[big] += self.saved[small] + self.chars[edge][d]
        self.least[big] = min(self.least[big], self.least[small])
        if len(self.waiting[big]) < len(self.waiting[small]):
            self.waiting[big], self.waiting[small] = self.waiting[small], self.waiting[big]
        self.waiting[big] += self.waiting[small]
        self.waiting[small] = []

    def _give(self, x: int, d: int) -> None:
        """Gives out the nodes of a component that are deeper than d, and makes it a child at d."""
        low, high, top = self.low[x], self.high[x], self.top[x]
        path = self.paths[0] if low == 0 else self.paths[1] if high == self.n - 1 else None
        for row in self.waiting[x]:
            if path is None:
                row[4] = self.least[x]
            else:
                row[11] = path[top]
        self.waiting[x] = []
        n, sums = high - low + 1, self.chars[low]
        ends = ""
        if self.depth[low] == top:
            ends = ",".join(str(self.rows[i][2]) for i in range(low, self.same[low]))
        if path is None:
            for k in range(top, d, -1):
                saved = self.saved[x] - (n - 1) * sums[k - 1] if k else self.saved[x]
                hashed = hashlib.sha256(ends.encode()).hexdigest() if k == top and ends else _EMPTY
                self.out.append(
                    [_FINAL, self.block, self.least[x], k, self.least[x], n, self.children[x] if k == top else 1,
                     self.leaves[x], saved, hashed, None, None, None, None, None, None]
                )
            self.waiting[x] = [self.out[-1]]
        else:
            first, last = low == 0, high == self.n - 1
            for k in range(top, d, -1):
                children = (self.children[x] if k == top else 1) - int(first and self.depth[0] > k)
                self.out.append(
                    [_OPEN, self.block, self.least[x], k, None, n, children, self.leaves[x], self.saved[x], None, path[k],
                     path[k - 1] if k else None, sums[k - 1] if k else 0, sums[k], self.depth[0] if first else None, self.depth[-1] if last else None]
                )
            if ends:
                self.out.append([_ENDS, self.block, None, top, None, None, None, None, None, ends, path[top], None, None, None, None, None])
        self.top[x], self.children[x] = d, 1


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[bytes, list[int], int]]]:
    rows, held = [], 0
    for batch in batches:
        for keys, chars, conv_id in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            rows.append((keys, chars, conv_id))
            held += len(keys)
            if len(rows) >= BLOCK or held >= BLOCK_BYTES:
                yield rows
                rows, held = [], 0
    if rows:
        yield rows


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    for rows in _blocks(batches):
        out = Forest(number, rows).build()
        for at in range(0, len(out), 1 << 16):
            columns = zip(*out[at : at + (1 << 16)], strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, (_, _, t) in zip(columns, _FIELDS, strict=True)], names=[name for name, _, _ in _FIELDS]
            )
        number += 1


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts sorted by node and block to one hash per node."""
    node, state = None, None
    for batch in batches:
        done: list[tuple[bytes, str]] = []
        for key, ends in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if key != node:
                if state is not None:
                    done.append((node, state.hexdigest()))
                node, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(ends.as_py().encode())
        yield _hashes(done)
    if state is not None:
        yield _hashes([(node, state.hexdigest())])


def _hashes(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends"])


def _merged(parts: DataFrame) -> DataFrame:
    """The open nodes of all blocks, each once: node, parent and the outputs' numbers."""
    spark = parts.sparkSession
    opened = parts.where(F.col("kind") == _OPEN)
    # One number per block, in the rows' order: which block follows which.
    blocks = sorted(r.block for r in opened.where("depth = 0").select("block").collect())
    pairs = spark.createDataFrame(list(zip(blocks, blocks[1:])), "before long, block long")  # noqa: B905
    firsts = opened.where(F.col("first_depth").isNotNull()).select("block", "node", "depth", "upto")
    lasts = opened.where(F.col("last_depth").isNotNull()).select(F.col("block").alias("before"), "node")
    # What a block's first row shares with the last row before it.
    edges = firsts.join(F.broadcast(pairs), "block").join(lasts, ["before", "node"]).groupBy("before", "block").agg(
        F.max("depth").alias("edge"), F.max("upto").alias("edge_chars")
    )
    into = edges.select("block", "edge", "edge_chars")
    out = edges.select(F.col("before").alias("block"), F.col("edge").alias("next_edge"))
    known = opened.join(into, "block", "left").join(out, "block", "left")
    edge = F.coalesce("edge", F.lit(-1))
    child = (F.col("first_depth") > F.col("depth")) & (F.col("depth") >= edge)
    leaf = F.col("last_depth").isNotNull() & (F.coalesce("next_edge", F.lit(-1)) < F.col("last_depth"))
    shared = F.when(F.col("first_depth").isNotNull() & (F.col("depth") <= edge), F.col("edge_chars")).otherwise(0)
    sums = known.groupBy("node").agg(
        F.first("parent", True).alias("parent"), F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum(F.col("n_children") + F.coalesce(child, F.lit(False)).cast("long")).alias("n_children"),
        F.sum(F.col("n_leaves") + leaf.cast("long")).alias("n_leaves"),
        F.sum(F.col("saved") + shared).alias("saved"), F.first("before").alias("chars_before"),
    )
    ends = parts.where(F.col("kind") == _ENDS).select("node", "block", "ends")
    ends = ends.repartition("node").sortWithinPartitions("node", "block").select("node", "ends").mapInArrow(_hashed, "node binary, ends string")
    return sums.join(ends, "node", "left").select(
        "node", "parent", "depth", "conv_id", "n_convs", "n_children", "n_leaves",
        (F.col("saved") - (F.col("n_convs") - 1) * F.col("chars_before")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(_EMPTY)).alias("ends_sha256"),
    )


def _written(df: DataFrame, name: str) -> DataFrame:
    folder = new_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of conversations (conv_id, turns: an array of (key, chars)), a row each."""
    keys = F.array_join(F.transform("turns", lambda t: F.hex(t["key"])), "")
    rows = conversations.select(F.unhex(keys).alias("keys"), F.transform("turns", lambda t: t["chars"]).alias("chars"), "conv_id")
    ordered = rows.repartitionByRange("keys", "conv_id").sortWithinPartitions("keys", "conv_id")
    parts = _written(ordered.mapInArrow(_forests, _SCHEMA), "trie-parts")
    merged = _written(_merged(parts), "trie-open")
    names = merged.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_name"))
    numbers = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    final = parts.where(F.col("kind") == _FINAL).withColumnsRenamed({"saved": "saved_tokens", "ends": "ends_sha256"})
    inner = final.where(F.col("parent").isNull()).select(*numbers)
    seen = parts.where(F.col("kind") == _OPEN).select("block", F.col("node").alias("parent")).join(names, "parent")
    below = final.where(F.col("parent").isNotNull()).drop("parent_conv_id").join(seen, ["block", "parent"])
    above = merged.join(names, "parent", "left")
    both = (x.withColumnRenamed("parent_name", "parent_conv_id").select(*numbers) for x in (below, above))
    return inner.unionByName(next(both)).unionByName(next(both))
