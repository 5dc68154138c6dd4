"""Near-duplicates and nearest neighbours against brute force."""

from __future__ import annotations

import math
import random
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from scorelake.llm import ann, near_dedup

SCHEMA = "doc_id long, text string, score double, KEPT string"


def _set(text, width):
    words = [w.lower() for w in (text or "").split()]
    if not words:
        return frozenset()
    n = min(width, len(words))
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def _components(rows, width, percent=80):
    sets = [_set(t, width) for _, t in rows]
    label = list(range(len(rows)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                label[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        least.setdefault(root(i), []).append(doc_id)
    known = {r: min((x for x in ids if x is not None), default=None) for r, ids in least.items()}
    return [(d, len(sets[i]), known[root(i)], d == known[root(i)]) for i, (d, _) in enumerate(rows)]


def _corpus():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = " ".join(word() for _ in range(40))
    base = [word() for _ in range(90)]
    texts = [None, "", " \t\n", "one", "ONE", "one two three", "One Two\vthree", "é É", "😀 x"]
    for _ in range(330):  # a large group of near copies, some linked through others only
        some = list(base)
        for _ in range(rng.randint(0, 5)):
            some[rng.randrange(len(some))] = word()
        texts.append(" ".join(some))
    texts += [passage + " " + " ".join(word() for _ in range(rng.randint(3, 60))) for _ in range(60)]
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(40)]
    texts += texts[9:20] * 3
    long = [word() for _ in range(20000)]
    texts += [" ".join(long), " ".join(long[:-900])]
    rows = [(i, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return [*rows, (None, "one"), (None, "alone in this table"), (3, "one"), (7, "é É")]


def test_components_equal_brute_force(spark):
    rows = _corpus()
    df = spark.createDataFrame([(d, t.encode("utf-8", "replace").decode() if t else t, 0.5, "x") for d, t in rows], SCHEMA).repartition(5)
    rows = [(d, t.encode("utf-8", "replace").decode() if t else t) for d, t in rows]
    got = near_dedup.near_duplicates(df, width=4)
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2] is None, r[2] or 0, r[3])
    want = [(d, n, c, k or (d is None and c is None)) for d, n, c, k in _components(rows, 4)]
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    kept = near_dedup.keep_one(df, width=4).collect()
    empties = sum(not (t or "").split() for _, t in rows)
    sets = {(c, n > 0) for d, n, c, _ in want if n}
    nameless = sum(1 for d, n, c, _ in want if n and c is None)
    assert len(kept) == empties + len({c for c, _ in sets if c is not None}) + nameless
    assert kept[0].asDict().keys() == {"doc_id", "text", "score", "KEPT"}


def test_no_documents(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert near_dedup.near_duplicates(df).collect() == []
    assert near_dedup.keep_one(df).collect() == []


def test_common_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 300, n).astype(np.uint64)) for n in rng.integers(1, 90, 60)]
    want = [[len(set(a.tolist()) & set(b.tolist())) for b in sets] for a in sets]
    for limit in (2, 24, 1000):
        assert near_dedup.common_counts(sets, limit).tolist() == want


def test_forest_in_blocks(monkeypatch):
    """Components equal brute force while no matrix is larger than two blocks."""
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(9):
        own = rng.integers(0, 1 << 40, 40)
        sets += [np.unique(np.r_[own[rng.permutation(40)[: rng.integers(34, 41)]], [1, 2]]).astype(np.uint64) for _ in range(7)]
    sets = [sets[i] for i in rng.permutation(len(sets))]
    sizes, counts = [], near_dedup.common_counts
    monkeypatch.setattr(near_dedup, "common_counts", lambda some: sizes.append(len(some)) or counts(some))
    monkeypatch.setattr(near_dedup, "BLOCK", 5, raising=False)
    monkeypatch.setattr(near_dedup, "PAIRS", 7, raising=False)

    def components(pairs):
        of = list(range(len(sets)))
        for a, b in pairs:
            of = [of[a] if x == of[b] else x for x in of]
        return {frozenset(i for i, x in enumerate(of) if x == k) for k in of}

    members = [set(s.tolist()) for s in sets]
    want = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(members[a] & members[b]) >= 80 * len(members[a] | members[b])]
    links = near_dedup.forest(sets, 80)
    assert components(links) == components(want) and len(links) == len(sets) - len(components(want))
    assert max(sizes) <= 10


def _cosine(a, b):
    dot = na = nb = 0.0
    for x, y in zip(a, b, strict=True):
        dot, na, nb = dot + x * y, na + x * x, nb + y * y
    return max(-1.0, min(1.0, dot / (math.sqrt(na) * math.sqrt(nb))))


@pytest.mark.parametrize("blocks", [(16384, 2048), (7, 16), (16384, 2048, 100)])
def test_nearest_equals_brute_force(spark, blocks, monkeypatch):
    if len(blocks) == 3:  # five vectors of 20 components fill a block
        monkeypatch.setattr(ann, "QUERY_VALUES", blocks[2])
        monkeypatch.setattr(ann, "CANDIDATE_VALUES", blocks[2])
    rng = np.random.default_rng(3)
    vectors = {i: [float(np.float32(x)) for x in rng.standard_normal(20)] for i in range(120)}
    for i in range(40, 90):
        vectors[i] = vectors[0]  # many equal vectors: ties by id
    vectors[5] = [x * 1e30 for x in vectors[6]]
    odd = [(200, None), (201, []), (202, [0.0] * 20), (203, [float("nan")] + [1.0] * 19), (None, vectors[1]), (204, [None] + [1.0] * 19), (205, [1.0, 2.0])]
    rows = [*vectors.items(), *odd, (0, vectors[0])]
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, score string").repartition(3)
    got = ann.nearest(df.where("vec_id % 10 = 0"), df, k=5, query_block=blocks[0], candidate_block=blocks[1])
    found = sorted(map(tuple, got.collect()))
    exact = {i: np.float32(v).astype(float).tolist() for i, v in vectors.items()}
    want = []
    for q in range(0, 120, 10):
        ranked = sorted((-_cosine(exact[q], exact[c]), c) for c in exact if c != q)[:5]
        want += [(q, r, c, -s) for r, (s, c) in enumerate(ranked, 1)]
    assert [x[:3] for x in found] == [x[:3] for x in want]
    assert [x[3] for x in found] == pytest.approx([x[3] for x in want], abs=1e-12)


def test_vectors_become_a_matrix_without_objects():
    x = np.random.default_rng(1).standard_normal((16384, 1024)).astype(np.float32)
    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, 1024), pa.int32()), pa.array(x.ravel()))
    before = time.process_time()
    got = ann._matrix(pa.chunked_array([lists.slice(0, 5000), lists.slice(5000)]))
    assert time.process_time() - before < 2 and got.dtype == np.float64 and np.array_equal(got, x)


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert ann.nearest(df, df).collect() == []


@pytest.mark.parametrize(("bits", "most"), [(16, 1 << 27), (16, 1 << 15), (1 << 40, 1 << 12)])
def test_key_filters_never_miss(spark, monkeypatch, bits, most):
    monkeypatch.setattr(near_dedup, "KEY_BITS", bits)
    monkeypatch.setattr(near_dedup, "MOST_BITS", most)
    keys = spark.range(5000).select(F.xxhash64(F.col("id") * 3).alias("h")).union(spark.range(1).select(F.xxhash64(F.lit(None).cast("long"))))
    rows = spark.range(30000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"))
    passed = {r.k for r in near_dedup.with_among(rows, "among", F.xxhash64("k"), keys).where("among").collect()}
    assert passed >= {None, *range(3, 15000, 3)}
    if most == 1 << 27:
        assert len(passed) < 7000
    none = near_dedup.with_among(rows, "among", F.xxhash64("k"), keys.where("false"))
    assert none.columns == ["k", "among"] and (most < 5000 or none.where("among").count() == 0)
