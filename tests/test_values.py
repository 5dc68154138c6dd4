"""Rounding and missing-value rules."""

from __future__ import annotations

import math
import random

from pyspark.sql import functions as F

from scorelake.functions.values import nan_to_null, round_half_even, strip


def test_rounding_equals_exact_rounding(spark):
    pick = random.Random(7)
    values = [0.00015, 0.03125, 0.79996, 2.5, -2.5, 0.0, 1e-9, 0.00005, 123456.78905, 1.00005]
    values += [pick.uniform(-5, 5) for _ in range(3000)] + [pick.randint(0, 10**6) / 2**pick.randint(0, 20) for _ in range(3000)]
    values += [k / 20000 for k in range(2000)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (3, 4, 6):
        got = df.select("v", round_half_even("v", digits).alias("r")).collect()
        wrong = [(r.v, r.r, round(r.v, digits)) for r in got if r.r != round(r.v, digits)]
        assert not wrong, wrong[:5]


def test_nan_to_null(spark):
    df = spark.createDataFrame([(1.0, "a"), (math.nan, "b")], "v double, s string")
    assert [r.v for r in nan_to_null(df).collect()] == [1.0, None]


def test_strip_unicode_whitespace(spark):
    df = spark.createDataFrame([("\u3000\x85 a b\x0b\n",)], "t string")
    assert df.select(strip(F.col("t")).alias("t")).first().t == "a b"
