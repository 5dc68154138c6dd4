"""The prefix trie against brute force, over blocks and partitions of any size."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from scorelake.llm import prefix_trie
from scorelake.llm.prefix_trie import Forest, rebuilt, trie, turns_of
from scorelake.llm.trie_queries import SQL

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _rebuilt(rows):
    """Conversations of rows (conv_id, turn, role, text) by the plain rule."""
    own: dict = {}
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            own.setdefault(conv_id, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns, key=_turn_order)] for c, turns in own.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        root = c - (abs(c) % 100 if c >= 0 else -(abs(c) % 100))
        out[c] = own.get(root, [])[:h] + turns[h:]
    return out


def _turn_order(t):
    role, text = t[2].encode(), t[3].encode()
    return t[0], t[1], hashlib.md5(str(len(role)).encode() + b":" + role + text).digest()


def brute(convs):
    members: dict = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for node, inside in members.items():
        below = [x for x in members if x[: len(node)] == node]
        children = [x for x in below if len(x) == len(node) + 1]
        leaves = [x for x in below if not any(y[: len(x)] == x and len(y) > len(x) for y in below)]
        saved = sum((len(members[x]) - 1) * (len(x[-1][1]) if x else 0) for x in below)
        ends = sorted(c for c in inside if len(convs[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        hashed = hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()
        out.append((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, hashed))
    return sorted(out, key=repr)


def _got(df):
    assert df.columns == NAMES
    return sorted(map(tuple, df.collect()), key=repr)


def _random_rows():
    rng = random.Random(5)
    rows = []
    for c in [*range(-120, 260), *rng.sample(range(1000, 9000), 60)]:
        n = rng.choice((1, 1, 2, 3, 5, 8))
        rows += [(c, k, rng.choice(("user", "assistant")) if k > 2 else "user", rng.choice(("a", "bb", "é😀", ""))) for k in range(n)]
    rows += [(c, k, "user", f"common {k}") for c in range(300, 420) for k in range(7)]  # one hot conversation
    rows += [(500, None, None, None), (500, 1, "user", None), (500, 1, "user", None), (None, 1, "user", "no id"), (501, 3, None, "x" * 70000)]
    rows += [(700, k, "user", str(k % 3)) for k in range(400)]  # long, and the head of its group
    rows += [(701, 0, "user", "0"), (705, 0, "user", "0")]
    return rows


@pytest.mark.parametrize(("block", "partitions"), [(1, 3), (3, 8), (1 << 14, 5), (50, 1)])
def test_trie_equals_brute_force(spark, monkeypatch, block, partitions):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    rows = _random_rows()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("keys", F.lit(1)).withColumn("root", F.lit(2))
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = _got(trie(rebuilt(turns_of(frame.repartition(6)))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert got == brute(_rebuilt(rows))


def test_turnless_conversations_and_empty_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    ids = [c for c in range(1, 100) if zlib.crc32(str(c).encode()) % 6 > 0][:9]
    rows = [(c, 0, "user", "gone") for c in ids]
    got = _got(trie(rebuilt(turns_of(spark.createDataFrame(rows, schema)))))
    ends = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    assert got == [(ids[0], 0, None, 9, 0, 1, 0, ends)]
    assert _got(trie(rebuilt(turns_of(spark.createDataFrame([], schema))))) == []


def test_a_block_by_itself():
    """Edges are merged in descending depth: every merge below a component's top gives a branching node."""
    key = lambda *turns: b"".join(hashlib.md5(t.encode()).digest() for t in turns)
    convs = sorted([(key("a"), [1], 9), (key("a", "b"), [1, 2], 4), (key("a", "c"), [1, 3], 5), (key("a", "c"), [1, 3], 7), (key("d"), [4], 1)])
    out = Forest(0, convs).build()
    by_kind = {k: [r for r in out if r[0] == k] for k in (0, 1, 2)}
    assert {(r[2], r[3]) for r in by_kind[0]} | {(r[2], r[3]) for r in by_kind[1]} == {(1, 0), (1, 1), (4, 1), (4, 2), (5, 2)}
    assert len(by_kind[0]) + len(by_kind[1]) == 5


def test_query_equals_its_sql(spark):
    import duckdb

    from scorelake.llm.trie_queries import op13_prefix_trie

    sf_dir = "/root/testdata/sf0.001"
    duckdb_rows = duckdb.connect()
    duckdb_rows.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    found = duckdb_rows.execute(SQL["op13_prefix_trie"])
    at = [[d[0] for d in found.description].index(n) for n in NAMES]
    assert _got(op13_prefix_trie(spark, sf_dir)) == sorted((tuple(r[i] for i in at) for r in found.fetchall()), key=repr)
