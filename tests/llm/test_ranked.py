"""Ranked search against brute force, and that bounds are bounds."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scorelake.llm import ranked
from scorelake.llm.ranked import build_index, search
from scorelake.sources.workspace import new_folder

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _terms(text):
    return Counter(_TERM.findall((text or "").translate(_LOWER)))


def brute(docs, queries, best=20):
    counted = [(doc_id, _terms(text)) for doc_id, text in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    asked: dict = {}
    for item, text in dict.fromkeys(queries):
        asked.setdefault(item, Counter()).update(_terms(text))
    out = []
    for item, terms in asked.items():
        df = {t: sum(t in c for _, c, _ in counted) for t in terms}
        found = []
        for doc_id, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // length
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 12 * m))
                for t, times in terms.items()
                if t in c
            )
            if score > 0:
                found.append((score, doc_id))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        out += [(item, rank, doc_id, score) for rank, (score, doc_id) in enumerate(found[:best], 1)]
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _found(df):
    return sorted(map(tuple, df.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))


def _random_docs():
    rng = random.Random(3)
    words = [f"w{int(rng.paretovariate(0.6))}" for _ in range(4000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice((1, 5, 40, 300))))) for i in range(400)]
    docs += [(1000 + i, docs[7][1]) for i in range(40)]  # ties at the last rank
    docs += [
        (7, docs[7][1]), (2000, None), (2001, ""), (2002, "-- !"), (None, docs[8][1]), (-5, "W1 w1 É é 😀x"),
        (2003, "w3 " * 5000 + "w4"), (2004, " ".join(f"u{i}" for i in range(30000)) + " w9"),
    ]
    queries = [(i, " ".join(rng.choices(words, k=12))) for i in range(30)]
    queries += [(30, "É é, unheard"), (31, None), (32, "..."), (33, "w3 w3 W4"), (33, "w3 w3 W4"), (33, "w9"), (None, "w5 w6"), (34, "u17 w9")]
    return docs, queries


@pytest.mark.parametrize(("best", "block_terms"), [(20, 1 << 14), (3, 25)])
def test_search_equals_brute_force(spark, monkeypatch, best, block_terms):
    docs, queries = _random_docs()
    monkeypatch.setattr(ranked, "CELLS", 2000)
    monkeypatch.setattr(ranked, "PIECE", 64)
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("term", F.lit("x")).withColumn("score", F.lit(1))
    index = build_index(frame.repartition(5), new_folder(spark, "lexical"))
    asked = spark.createDataFrame(queries, "item_id long, text string").withColumn("rank", F.lit(0))
    got = search(index, asked, best, block_terms=block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert _found(got) == brute(docs, queries, best)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert search(build_index(none, new_folder(spark, "lexical")), asked).collect() == []
    assert search(build_index(some, new_folder(spark, "lexical")), asked.limit(0)).collect() == []
    assert _found(search(build_index(some, new_folder(spark, "lexical")), asked)) == brute([(1, "a b")], [(1, "a")])


class _Row:
    def __init__(self, item_id, term, times, df):
        self.item_id, self.term, self.times, self.df = item_id, term, times, df


@given(st.dictionaries(st.binary(min_size=1, max_size=3), st.integers(1, 600), min_size=1, max_size=300), st.integers(75, 10**7), st.randoms())
@settings(max_examples=60, deadline=None)
def test_bounds_are_never_below_scores(counts, m, rng):
    terms = list(counts)
    tfs = np.array([counts[t] for t in terms], "<u4")
    asked = rng.sample(terms, min(len(terms), 20)) + [b"absent%d" % i for i in range(20)]
    block = ranked.Block.of([_Row(1, t, rng.randint(1, 9), rng.randint(1, 50)) for t in asked], 1000)
    bound = block.bounds(ranked.sketch_of(terms, tfs)[None], np.array([m], np.float64))[0, 0]
    exact = sum(w * ranked.impact(counts[t], m) for t, w in block.terms[0] if t in counts)
    assert bound >= exact


def test_few_documents_are_scored(spark, monkeypatch):
    """Bounds are tight enough that a small part of all pairs is scored."""
    docs, queries = _random_docs()
    docs = [d for d in docs if _terms(d[1])]
    scored = []
    monkeypatch.setattr(ranked._Document, "score", lambda self, weighted, own=ranked._Document.score: scored.append(1) or own(self, weighted))
    import pyarrow as pa

    made, holding = [], Counter()
    for doc_id, text in docs:
        counts = ranked.term_counts(text)
        terms, tfs = list(counts), np.fromiter(counts.values(), "<u4", len(counts))
        holding.update(terms)
        made.append((doc_id, int(tfs.sum()), ranked.sketch_of(terms, tfs).tobytes(), b" ".join(terms), tfs.tobytes()))
    rows = [_Row(i, t, c, holding[t]) for i, text in queries[:30] for t, c in ranked.term_counts(text).items() if t in holding]
    batch = pa.RecordBatch.from_arrays([pa.array([m[i] for m in made]) for i in range(5)], names=list("abcde"))
    list(ranked._finds(ranked.Block.of(rows, len(docs)), len(docs), sum(m[1] for m in made), 5)(iter([batch])))
    assert len(scored) < 0.1 * 30 * len(docs)
