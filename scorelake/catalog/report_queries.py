"""Report tables and cross-run comparison over summaries of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.catalog import bindings, metric_sql
from scorelake.catalog.bindings import with_bindings
from scorelake.functions.values import available
from scorelake.operators import compare, summary

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _summary(spark, sf_dir) -> DataFrame:
    return summary.summarize(bindings.scored(spark, sf_dir), rounded=False)


def _places(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 10) for c in columns})


def _r(*columns: str) -> str:
    return ", ".join(f"round({c}, 10) AS {c}" for c in columns)


def _over_summary(select: str) -> str:
    return with_bindings("scored", f"WITH {metric_sql.SUMMARY.strip()}\n{select}")


_ORDER = "ORDER BY composite DESC NULLS LAST, model_slug"


def overall_rows(spark, sf_dir):
    """Rollup rows, best first."""
    rows = compare.overall_rows(_summary(spark, sf_dir))
    return _places(rows.select("model_slug", "composite", "cost_per_run"), "composite")


SQL["overall_rows"] = _over_summary(
    f"SELECT model_slug, {_r('composite')}, cost_per_run FROM summary WHERE track = 'ALL'"
)


def track_rows(spark, sf_dir):
    """Per-track rows without the rollup."""
    return compare.track_rows(_summary(spark, sf_dir)).select("track", "model_slug", "composite", "tier")


SQL["track_rows"] = _over_summary(
    "SELECT track, model_slug, composite, tier FROM summary WHERE track <> 'ALL'"
)


def track_list(spark, sf_dir):
    """Sorted distinct track names."""
    return compare.track_list(_summary(spark, sf_dir))


SQL["track_list"] = with_bindings("scored", "SELECT DISTINCT track FROM v_scored ORDER BY track")


def report_tables(spark, sf_dir):
    """The leaderboard and one ranked table per track."""
    tables = compare.report_tables(_summary(spark, sf_dir))
    return _places(tables, "composite", "composite_std")


_SHOWN = ", ".join(
    f"round({c}, 10) AS {c}" if c.startswith("composite") else c for c in fixed.LEADERBOARD_COLUMNS
)
SQL["report_tables"] = _over_summary(
    f"SELECT track, row_number() OVER (PARTITION BY track {_ORDER}) AS position, model_slug, {_SHOWN} FROM summary"
)


def cost_quality(spark, sf_dir):
    """Cost and quality points with tier."""
    return _places(compare.cost_quality(_summary(spark, sf_dir)), "composite")


SQL["cost_quality"] = _over_summary(
    f"SELECT model_slug, cost_per_run, {_r('composite')}, tier FROM summary WHERE track = 'ALL'"
)


def cost_quality_range(spark, sf_dir):
    """Ranges of the cost-quality points."""
    ranges = compare.cost_quality_range(_summary(spark, sf_dir))
    return _places(ranges, *ranges.columns)


SQL["cost_quality_range"] = _over_summary(
    """SELECT round(min(composite), 10) AS composite_min, round(max(composite), 10) AS composite_max,
         round(min(log10(cost_per_run)) FILTER (cost_per_run > 0), 10) AS log_cost_min,
         round(max(log10(cost_per_run)) FILTER (cost_per_run > 0), 10) AS log_cost_max
       FROM summary WHERE track = 'ALL'"""
)


def metric_by_model(spark, sf_dir):
    """One metric by name over the rollup rows."""
    return compare.metric_by_model(_summary(spark, sf_dir), "tok_per_s")


SQL["metric_by_model"] = _over_summary(
    "SELECT model_slug, 'tok_per_s' AS metric, tok_per_s AS value FROM summary WHERE track = 'ALL'"
)

_LONG = ("recall", "precision", "coverage", "dry_score", "mean_latency_s")


def metrics_long(spark, sf_dir):
    """Several metrics of the rollup rows in long form."""
    return compare.metrics_long(_summary(spark, sf_dir), _LONG)


SQL["metrics_long"] = _over_summary(
    " UNION ALL ".join(
        f"SELECT model_slug, '{m}' AS metric, {m} AS value FROM summary WHERE track = 'ALL'" for m in _LONG
    )
)


def pass_rates(spark, sf_dir):
    """One-shot and multi-shot pass rates and their gap."""
    return compare.pass_rates(_summary(spark, sf_dir))


SQL["pass_rates"] = _over_summary(
    """SELECT model_slug, one_shot_pass_rate, multi_shot_pass_rate, multi_shot_pass_rate - one_shot_pass_rate AS gap
       FROM summary WHERE track = 'ALL'"""
)


def track_grid(spark, sf_dir):
    """Composite by model and track."""
    return compare.track_grid(_summary(spark, sf_dir))


_GRID = ", ".join(
    f"max(composite) FILTER (track = '{t}') AS {t}" for t in fixed.TRACK_NAMES
)
SQL["track_grid"] = _over_summary(f"SELECT model_slug, {_GRID} FROM summary WHERE track <> 'ALL' GROUP BY 1")


def category_composites(spark, sf_dir):
    """Mean composite on component and on system tracks."""
    return _places(compare.category_composites(_summary(spark, sf_dir)), "component", "system")


SQL["category_composites"] = _over_summary(
    """SELECT model_slug, round(avg(composite) FILTER (track NOT LIKE 'e2e%'), 10) AS component,
         round(avg(composite) FILTER (track LIKE 'e2e%'), 10) AS system
       FROM summary WHERE track <> 'ALL' GROUP BY 1"""
)


def track_profile(spark, sf_dir):
    """Composite per track with models in overall order."""
    return compare.track_profile(_summary(spark, sf_dir))


SQL["track_profile"] = _over_summary(
    f"""SELECT s.track, position, model_slug, s.composite FROM summary s
        JOIN (SELECT model_slug, row_number() OVER ({_ORDER}) AS position FROM summary WHERE track = 'ALL') USING (model_slug)
        WHERE s.track <> 'ALL'"""
)


def scorecard(spark, sf_dir):
    """The chosen overall metrics per model."""
    return _places(compare.scorecard(_summary(spark, sf_dir)), "composite", "composite_std")


_CARD = ", ".join(
    f"round({c}, 10) AS {c}" if c.startswith("composite") else c for c in fixed.SCORECARD_METRICS
)
SQL["scorecard"] = _over_summary(f"SELECT model_slug, tier, {_CARD} FROM summary WHERE track = 'ALL'")


def pattern_matrix(spark, sf_dir):
    """Technique adoption per model on the advanced track."""
    return compare.pattern_matrix(bindings.scored(spark, sf_dir))


SQL["pattern_matrix"] = with_bindings(
    "scored",
    """SELECT model_slug, avg(CAST(uses_polling AS INTEGER)) AS uses_polling, avg(CAST(uses_network AS INTEGER)) AS uses_network,
         avg(CAST(uses_api AS INTEGER)) AS uses_api FROM v_scored WHERE track = 'e2e_advanced' GROUP BY 1""",
)


def adoption_order(spark, sf_dir):
    """Position of each model when sorted by all adoption columns."""
    from pyspark.sql import Window as W

    rates = compare.pattern_matrix(bindings.scored(spark, sf_dir))
    flags = available(rates, [f"uses_{p}" for p in fixed.PATTERN_TECHNIQUES])
    place = F.row_number().over(W.orderBy(*(F.desc_nulls_last(c) for c in flags), "model_slug"))
    return rates.select("model_slug", place.cast("long").alias("place"))


SQL["adoption_order"] = with_bindings(
    "scored",
    """WITH rates AS (SELECT model_slug, avg(CAST(uses_polling AS INTEGER)) AS p, avg(CAST(uses_network AS INTEGER)) AS n,
         avg(CAST(uses_api AS INTEGER)) AS a FROM v_scored WHERE track = 'e2e_advanced' GROUP BY 1)
       SELECT model_slug, row_number() OVER (ORDER BY p DESC, n DESC, a DESC, model_slug) AS place FROM rates""",
)

# --- Several runs ---------------------------------------------------------------

# Run "first" lacks the last trial of some models; run "second" is newer and has only those. Together they hold all rows.
_RUNS = (
    ("first", "2024-01-01 00:00:00", "(trial < 2 OR model_slug < 'm05')"),
    ("second", "2024-02-01 00:00:00", "model_slug >= 'm05'"),
)


def _runs(spark, sf_dir) -> list[DataFrame]:
    scored = bindings.scored(spark, sf_dir)
    return [
        summary.summarize(scored.filter(rows), rounded=False).select(
            F.lit(run_id).alias("run_id"), F.lit(mtime).cast("timestamp").alias("run_mtime"), "*"
        )
        for run_id, mtime, rows in _RUNS
    ]


_RUN_SQL = ", ".join(
    f"rows_{i} AS (SELECT * FROM v_scored WHERE {rows}), {metric_sql.summary_ctes(f'rows_{i}', f'_{i}').strip()}"
    for i, (_, _, rows) in enumerate(_RUNS)
)


def _over_runs(select: str) -> str:
    return with_bindings("scored", f"WITH {_RUN_SQL} {select}")


def latest_per_model(spark, sf_dir):
    """Every model at its newest run."""
    rows = compare.latest_per_model(compare.union_summaries(*_runs(spark, sf_dir)))
    return _places(rows.select("run_id", "model_slug", "track", "n_trials", "composite"), "composite")


SQL["latest_per_model"] = _over_runs(
    """SELECT 'second' AS run_id, model_slug, track, n_trials, round(composite, 10) AS composite FROM summary_1
       UNION ALL SELECT 'first', model_slug, track, n_trials, round(composite, 10) FROM summary_0
       WHERE model_slug NOT IN (SELECT model_slug FROM summary_1)"""
)


def union_summaries(spark, sf_dir):
    """Summaries with differing columns as one table."""
    first, second = _runs(spark, sf_dir)
    both = compare.union_summaries(
        first.select("run_id", "model_slug", "track", "recall"),
        second.select("run_id", "model_slug", "track", "coverage"),
    )
    return both


SQL["union_summaries"] = _over_runs(
    """SELECT 'first' AS run_id, model_slug, track, recall, NULL::DOUBLE AS coverage FROM summary_0
       UNION ALL SELECT 'second', model_slug, track, NULL, coverage FROM summary_1"""
)


def models_not_in_newer(spark, sf_dir):
    """Models the newer run does not have."""
    first, second = _runs(spark, sf_dir)
    return compare.models_not_in(first, second)


SQL["models_not_in_newer"] = with_bindings(
    "scored",
    """SELECT DISTINCT model_slug FROM v_scored WHERE trial < 2 OR model_slug < 'm05'
       EXCEPT SELECT model_slug FROM v_scored WHERE model_slug >= 'm05'""",
)


def run_difference(spark, sf_dir):
    """Change of metrics from the older to the newer run."""
    first, second = _runs(spark, sf_dir)
    diff = compare.run_difference(first, second, ("recall", "cost_per_run"))
    return diff


SQL["run_difference"] = _over_runs(
    """SELECT model_slug, track, b.recall AS recall_before, a.recall AS recall_after, a.recall - b.recall AS recall_change,
         b.cost_per_run AS cost_per_run_before, a.cost_per_run AS cost_per_run_after, a.cost_per_run - b.cost_per_run AS cost_per_run_change
       FROM summary_0 b FULL JOIN summary_1 a USING (model_slug, track)"""
)

for _fn in (
    overall_rows, track_rows, track_list, report_tables, cost_quality, cost_quality_range,
    metric_by_model, metrics_long, pass_rates, track_grid, category_composites, track_profile,
    scorecard, pattern_matrix, adoption_order, latest_per_model, union_summaries,
    models_not_in_newer, run_difference,
):
    QUERIES[_fn.__name__] = _fn
