"""Registered queries against their SQL twins on the smallest data set.

A few by default; all of them with ALL_QUERIES=1.
"""

from __future__ import annotations

import json
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__ as entry  # noqa: E402

DATA = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
SOME = ("metric_composite", "summarize_rounded", "leaderboard", "text_job", "predicted_span", "attempt_rollup",
        "latest_per_model", "merge_fresh", "leak_scan", "running_summary")

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{DATA}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    return None if value is None else repr(value)


def _rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(json.dumps([_plain(r[i]) for i in order]) for r in records)


def test_every_twin_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()) if os.environ.get("ALL_QUERIES") else SOME)
def test_query_equals_sql(spark, engine, name):
    got = entry.queries()[name](spark, DATA)
    twin = engine.execute(entry.oracle_sql()[name])
    names = [c[0] for c in twin.description]
    assert sorted(got.columns) == sorted(names)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, twin.fetchall())
