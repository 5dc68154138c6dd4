"""The pipeline's stages in order, on the smallest tables."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from scorelake.llm.near_dedup import near_duplicates

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("block", F.lit(1))
    names, counts = docs.columns, {}
    before = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, before, DATA).write.parquet(str(tmp_path / name))
        after = spark.read.parquet(str(tmp_path / name))
        counts[name] = after.count()
        if name != "packing":
            assert after.columns == names
            assert after.join(before, "doc_id", "left_anti").count() == 0
        if name == "near_duplicates":
            groups = near_duplicates(before).select("component_id").distinct().count()
            assert counts[name] == groups
        if name == "mixture":
            assert after.select("doc_id").distinct().count() == counts["near_duplicates"]
        before = after
    assert 0 < counts["language"] <= counts["quality"] < 200 and counts["packing"] >= counts["mixture"]
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_empty_tables(spark, name, stage):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("false")
    after = stage(spark, docs, DATA)
    assert after.collect() == []
    assert name == "packing" or after.columns == docs.columns


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize(("name", "stage"), corpus_pipeline.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    """NULLs in every column, empty and very long texts, and repeated rows beside the table's own."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kinds = {f.name: f.dataType for f in docs.schema}
    nothing = [F.lit(None).cast(kind).alias(column) for column, kind in kinds.items()]
    one = docs.orderBy(F.length("text").desc(), "doc_id").limit(1)
    with_id = lambda i, text: one.withColumn("doc_id", F.lit(i).cast(kinds["doc_id"])).withColumn("text", text)
    odd = [
        spark.range(1).select(*nothing),
        with_id(10**9, F.lit("")),
        with_id(10**9 + 1, F.lit(None).cast("string")),
        with_id(10**9 + 2, F.repeat(F.concat("text", F.lit("\n")), 400)),
        one,
    ]
    before = docs
    for rows in odd:
        before = before.unionByName(rows.select(*docs.columns))
    before = before.cache()
    after = stage(spark, before, DATA).cache()
    if name == "packing":
        assert after.count() > 0
        return
    assert after.columns == docs.columns and after.exceptAll(before).count() == (after.count() - before.count() if name == "mixture" else 0)
    ids = {r.doc_id for r in after.select("doc_id").collect()}
    if name == "mixture":
        assert ids == {r.doc_id for r in before.select("doc_id").collect()}
    if name in ("quality", "language"):
        assert not ids & {None, 10**9, 10**9 + 1}
    if name == "near_duplicates":
        groups = near_duplicates(before).select("component_id").distinct().count()
        assert len(ids) == groups and {None, 10**9, 10**9 + 1} <= ids
