"""Metrics, summary and ranking queries over scored rows."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.catalog import bindings, metric_sql
from scorelake.catalog.bindings import with_bindings
from scorelake.functions.values import number, truth
from scorelake.operators import compare, metrics, summary
from scorelake.operators.opaque import Opaque

QUERIES: dict = {}
SQL: dict[str, str] = {}

# Second-level averages and deviations are compared at ten places: their inputs
# are no longer exact, and the engines add them in different orders.
_FUZZY = ("composite", "composite_std")


def _ten_places(df: DataFrame, columns=_FUZZY) -> DataFrame:
    return df.withColumns({c: F.round(c, 10) for c in columns if c in df.columns})


def _ten_places_sql(columns, fuzzy=_FUZZY) -> str:
    return ", ".join(f"round({c}, 10) AS {c}" if c in fuzzy else c for c in columns)


# --- One query per metric -------------------------------------------------------


def _metric(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.metric_table(bindings.scored(spark, sf_dir), [name])


for _name in metrics.METRICS:
    QUERIES[f"metric_{_name}"] = partial(_metric, _name)
    SQL[f"metric_{_name}"] = with_bindings(
        "scored",
        f"""WITH leveled AS (SELECT * FROM v_scored UNION ALL BY NAME
              SELECT * REPLACE ('ALL' AS track) FROM v_scored),
            measured AS ({metric_sql.grouped("leveled", "model_slug, track")})
            SELECT model_slug, track, {_name} FROM measured""",
    )


# --- Building blocks ------------------------------------------------------------


def sum_ratio(spark, sf_dir):
    """Ratio of sums by event type; an all-zero denominator gives NULL."""
    events = bindings.table(spark, sf_dir, "events").withColumns(
        {"num": F.col("event_id") % 8, "den": F.when(F.col("event_type") != "error", F.col("user_id") % 4)}
    )
    stats = metrics.Stats(events.columns)
    ratio = stats.rate("num", "den")
    return events.groupBy("event_type").agg(*stats.aggregates(events)).select(
        "event_type", ratio.alias("ratio")
    )


SQL["sum_ratio"] = """
SELECT event_type, sum(event_id % 8) / nullif(coalesce(sum(CASE WHEN event_type <> 'error' THEN user_id % 4 END), 0), 0) AS ratio
FROM events GROUP BY event_type"""


def numeric_coercion(spark, sf_dir):
    """Mean of a text column read as numbers; what does not parse is missing."""
    events = bindings.table(spark, sf_dir, "events").withColumn(
        "text_value",
        F.when(F.col("event_id") % 3 == 0, F.col("event_type"))
        .when(F.col("event_id") % 3 == 1, (F.col("event_id") % 16 / 4).cast("string"))
        .otherwise(F.lit("NaN")),
    )
    return events.groupBy("event_type").agg(F.avg(number(events, "text_value")).alias("mean_value"))


SQL["numeric_coercion"] = """
SELECT event_type, avg(CASE WHEN event_id % 3 = 1 THEN (event_id % 16) / 4.0::DOUBLE END) AS mean_value
FROM events GROUP BY event_type"""


def three_state_truth(spark, sf_dir):
    """Truth rates of a boolean, a number with NaN, and a text column."""
    key = F.col("event_id")
    events = bindings.table(spark, sf_dir, "events").select(
        "event_type",
        F.when(key % 5 != 0, key % 2 == 0).alias("flag"),
        F.when(key % 4 == 0, F.lit(float("nan"))).otherwise((key % 3).cast("double")).alias("amount"),
        F.lit("true").alias("word"),
    )
    return events.groupBy("event_type").agg(
        F.avg(truth(events, "flag")).alias("flag_rate"),
        F.avg(truth(events, "amount")).alias("amount_rate"),
        F.count(truth(events, "word")).alias("word_known"),
    )


SQL["three_state_truth"] = """
SELECT event_type, avg(CASE WHEN event_id % 5 <> 0 THEN CAST(event_id % 2 = 0 AS INTEGER) END) AS flag_rate,
  avg(CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 3 <> 0 AS INTEGER) END) AS amount_rate,
  CAST(0 AS BIGINT) AS word_known
FROM events GROUP BY event_type"""


def sample_counts(spark, sf_dir):
    """Distinct samples per (model, track) and per model."""
    return metrics.sample_counts(bindings.scored(spark, sf_dir))


SQL["sample_counts"] = with_bindings(
    "scored",
    """SELECT model_slug, track, count(DISTINCT sample_id) AS n_samples FROM v_scored GROUP BY 1, 2
       UNION ALL SELECT model_slug, 'ALL', count(DISTINCT sample_id) FROM v_scored GROUP BY 1""",
)


def correctness_by_track(spark, sf_dir):
    """Valid-output share by each track's own correctness column."""
    return metrics.correctness_by_track(bindings.scored(spark, sf_dir))


SQL["correctness_by_track"] = with_bindings(
    "scored",
    """SELECT model_slug, track, avg(CAST(coalesce(runs_and_valid, e2e_ran, repair_passed) AS INTEGER)) AS correctness
       FROM v_scored GROUP BY 1, 2""",
)


def headline_composite(spark, sf_dir):
    """Equal-weight mean of the composites of the headline tracks."""
    return _ten_places(summary.headline_composite(bindings.scored(spark, sf_dir)))


def trial_spread(spark, sf_dir):
    """Trials and sample deviation of the composite per (model, track)."""
    return _ten_places(summary.trial_spread(bindings.scored(spark, sf_dir)))


def headline_spread(spark, sf_dir):
    """Trials and sample deviation of the headline composite per model."""
    return _ten_places(summary.headline_spread(bindings.scored(spark, sf_dir)))


def _over_summary(select: str) -> str:
    return with_bindings("scored", f"WITH {metric_sql.SUMMARY.strip()}\n{select}")


SQL["headline_composite"] = _over_summary(
    "SELECT model_slug, round(composite, 10) AS composite FROM headline"
)
SQL["trial_spread"] = _over_summary(
    "SELECT model_slug, track, n_trials, round(composite_std, 10) AS composite_std FROM track_spread"
)
SQL["headline_spread"] = _over_summary(
    "SELECT model_slug, n_trials, round(composite_std, 10) AS composite_std FROM model_spread"
)


# --- Summary, tiers and ranks ---------------------------------------------------


def exact_summary(spark, sf_dir) -> DataFrame:
    return summary.summarize(bindings.scored(spark, sf_dir), rounded=False)


_SUMMARY_COLUMNS = ("model_slug", "track", "n_samples", "n_trials", *metrics.METRICS, "composite_std", "tier")


def summarize(spark, sf_dir):
    """The flagship: every metric per (model, track) and per model."""
    return _ten_places(exact_summary(spark, sf_dir))


SQL["summarize"] = _over_summary(f"SELECT {_ten_places_sql(_SUMMARY_COLUMNS)} FROM summary")


def summarize_rounded(spark, sf_dir):
    """The summary as written to disk: four places, ties to even."""
    return summary.summarize(bindings.scored(spark, sf_dir))


SQL["summarize_rounded"] = _over_summary(
    "SELECT "
    + ", ".join(
        f"{metric_sql.python_round(c)} AS {c}" if c in (*metrics.METRICS, "composite_std") else c
        for c in _SUMMARY_COLUMNS
    )
    + " FROM summary"
)


def tiers(spark, sf_dir):
    """Composite and tier of every summary row."""
    return _ten_places(exact_summary(spark, sf_dir).select("model_slug", "track", "composite", "tier"))


SQL["tiers"] = _over_summary(
    "SELECT model_slug, track, round(composite, 10) AS composite, tier FROM summary"
)


def overall_rollup(spark, sf_dir):
    """Rollup rows: pooled informational metrics with the headline composite."""
    return _ten_places(exact_summary(spark, sf_dir).filter(F.col("track") == fixed.OVERALL))


SQL["overall_rollup"] = _over_summary(
    f"SELECT {_ten_places_sql(_SUMMARY_COLUMNS)} FROM summary WHERE track = 'ALL'"
)


def leaderboard(spark, sf_dir):
    """Ranked overall rows with position and tier."""
    board = compare.leaderboard(exact_summary(spark, sf_dir))
    return _ten_places(board)


SQL["leaderboard"] = _over_summary(
    """SELECT row_number() OVER (ORDER BY composite DESC NULLS LAST, model_slug) AS position, model_slug,
         round(composite, 10) AS composite, round(composite_std, 10) AS composite_std, tier
       FROM summary WHERE track = 'ALL'"""
)


def opaque_metric(spark, sf_dir):
    """A metric in Python beside one of the registry: how many times the dearest run costs the cheapest."""
    spread = Opaque(
        ("cost",),
        lambda rows: (rows["cost"].min(), rows["cost"].max()),
        lambda a, b: (min(a[0], b[0]), max(a[1], b[1])),
        lambda state: state[1] / state[0] if state[0] else None,
    )
    return metrics.metric_table(bindings.scored(spark, sf_dir), ["recall", "cost_spread"], {"cost_spread": spread})


SQL["opaque_metric"] = with_bindings(
    "scored",
    """WITH leveled AS (SELECT * FROM v_scored UNION ALL SELECT * REPLACE ('ALL' AS track) FROM v_scored)
       SELECT model_slug, track, 1.0 - sum(mutants_surviving) / nullif(sum(mutants_total), 0) AS recall, max(cost) / min(cost) AS cost_spread
       FROM leveled GROUP BY 1, 2""",
)


def summary_ranks(spark, sf_dir):
    """Position of every summary row in the written order."""
    from pyspark.sql import Window as W

    rows = exact_summary(spark, sf_dir)
    place = F.row_number().over(
        W.partitionBy("track").orderBy(F.desc_nulls_last("composite"), "model_slug")
    )
    return rows.select("track", "model_slug", place.cast("long").alias("place"))


SQL["summary_ranks"] = _over_summary(
    """SELECT track, model_slug, row_number() OVER (PARTITION BY track ORDER BY composite DESC NULLS LAST, model_slug) AS place
       FROM summary"""
)

for _fn in (
    sum_ratio, numeric_coercion, three_state_truth, sample_counts, correctness_by_track,
    headline_composite, trial_spread, headline_spread, summarize, summarize_rounded, tiers,
    overall_rollup, leaderboard, summary_ranks, opaque_metric,
):
    QUERIES[_fn.__name__] = _fn
