"""Metrics as Python functions: states per task, merged; beside the registry's own."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from scorelake.operators.metrics import metric_table
from scorelake.operators.opaque import Opaque, opaque_table

SEEN: list[int] = []
# The median by a histogram of tenths, which no sum can say.
MEDIAN = Opaque(
    ("latency_s",),
    lambda rows: np.bincount((rows["latency_s"].dropna() * 10).astype(int), minlength=50),
    lambda a, b: a + b,
    lambda counts: None if not counts.sum() else float(np.searchsorted(np.cumsum(counts), (counts.sum() + 1) // 2) / 10),
)
LARGEST_BATCH = Opaque(("latency_s",), len, max, float)


def _rows(spark):
    n = 60000
    return spark.range(n, numPartitions=7).select(
        F.when(F.col("id") % 100 != 0, F.lit("hot")).otherwise(F.lit("cold")).alias("model_slug"),
        F.when(F.col("id") % 11 != 0, F.lit("t")).alias("track"),
        F.col("id").cast("string").alias("sample_id"),
        F.when(F.col("id") % 13 != 0, (F.col("id") * 7919 % 47) / 10).alias("latency_s"),
        (F.col("id") % 3 == 0).alias("passed"),
    )


def test_states_equal_whole_groups(spark):
    rows = _rows(spark)
    got = {(r.model_slug, r.track): r.median for r in metric_table(rows, ["multi_shot_pass_rate", "median"], {"median": MEDIAN}).collect()}
    for model in ("hot", "cold"):
        for track in ("t", "ALL"):
            own = rows.where((F.col("model_slug") == model) & (F.lit(track == "ALL") | (F.col("track") == track))).toPandas()["latency_s"].dropna()
            ordered = np.sort((own * 10).astype(int).to_numpy())
            assert got[model, track] == ordered[(len(ordered) + 1) // 2 - 1] / 10
    assert set(got) == {(m, t) for m in ("hot", "cold") for t in ("t", "ALL")}


def test_no_group_is_one_table(spark):
    largest = opaque_table(_rows(spark), {"n": LARGEST_BATCH}).where("model_slug = 'hot' AND track = 'ALL'").first().n
    assert largest <= 10000  # an Arrow batch, of 59400 rows in the group


def test_missing_inputs_and_empty_tables(spark):
    rows = _rows(spark)
    table = opaque_table(rows.drop("latency_s"), {"median": MEDIAN})
    assert {r.median for r in table.collect()} == {None}
    assert opaque_table(rows.limit(0), {"median": MEDIAN}).collect() == []


def test_tasks_without_rows(spark):
    dealt = spark.range(8, numPartitions=8).where("id IN (1, 3)").selectExpr("'m' AS model_slug", "'t' AS track", "cast(id AS double) AS cost")
    most = Opaque(("cost",), lambda g: g["cost"].max(), max, float)
    assert {r.track: r.most for r in opaque_table(dealt, {"most": most}).collect()} == {"t": 3.0, "ALL": 3.0}
    assert opaque_table(dealt.where("cost > 5"), {"most": most}).count() == 0
