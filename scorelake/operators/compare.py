"""Leaderboards, reports and cross-run comparison over summary tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.dimensions import track_dimension
from scorelake.functions.values import available, truth
from scorelake.operators.metrics import METRICS


def _by_composite():
    return F.desc_nulls_last("composite"), F.col("model_slug")


def overall_rows(summary: DataFrame) -> DataFrame:
    """The per-model rollup rows, best first."""
    return summary.filter(F.col("track") == fixed.OVERALL).orderBy(*_by_composite())


def track_rows(summary: DataFrame) -> DataFrame:
    """The per-track rows, by track and then best first."""
    return summary.filter(F.col("track") != fixed.OVERALL).orderBy("track", *_by_composite())


def track_list(summary: DataFrame) -> DataFrame:
    """Distinct track names, sorted."""
    return (
        summary.filter(F.col("track") != fixed.OVERALL).select("track").distinct().orderBy("track")
    )


def leaderboard(summary: DataFrame) -> DataFrame:
    """Overall rows with their position; one row per model, so one window is enough."""
    position = F.row_number().over(W.orderBy(*_by_composite()))
    return (
        summary.filter(F.col("track") == fixed.OVERALL)
        .withColumn("position", position.cast("long"))
        .select("position", "model_slug", "composite", "composite_std", "tier")
        .orderBy("position")
    )


def report_tables(summary: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """Leaderboard and one ranked table per track, with the run's manifest fields.

    Summaries of several runs are ranked run by run if they have a ``run_id``.
    """
    runs = available(summary, ["run_id"])
    rank = F.row_number().over(W.partitionBy(*runs, "track").orderBy(*_by_composite()))
    shown = available(summary, fixed.LEADERBOARD_COLUMNS)
    table = summary.withColumn("position", rank.cast("long")).select(
        *runs, "track", "position", "model_slug", *shown
    )
    if manifest is not None:
        # Tracks, shots and judge of the run head its tables. A summary with run ids takes the row
        # of its run; one without can only be told apart if the manifest has a single row.
        fields = F.struct("run_id", "tracks", "shots", "judge_model").alias("run")
        if "run_id" in summary.columns:
            heads = manifest.select(F.col("run_id").alias("_run"), fields)
            table = table.join(heads, F.col("run_id") == F.col("_run"), "left").drop("_run")
        else:
            table = table.withColumn("run", manifest.select(fields).scalar())
    return table.orderBy("track", "position")


def cost_quality(summary: DataFrame) -> DataFrame:
    """Cost and quality of every model with its tier."""
    return overall_rows(summary).select("model_slug", "cost_per_run", "composite", "tier")


def cost_quality_range(summary: DataFrame) -> DataFrame:
    """Ranges of the cost-quality points; cost in log10, over positive costs."""
    points = summary.filter(F.col("track") == fixed.OVERALL)
    cost = F.when(F.col("cost_per_run") > 0, F.log10("cost_per_run"))
    return points.agg(
        F.min("composite").alias("composite_min"),
        F.max("composite").alias("composite_max"),
        F.min(cost).alias("log_cost_min"),
        F.max(cost).alias("log_cost_max"),
    )


def metric_by_model(summary: DataFrame, metric: str) -> DataFrame:
    """One metric over the overall rows; an unknown name gives no rows."""
    if metric not in summary.columns:
        return summary.limit(0).select(
            "model_slug", F.lit(metric).alias("metric"), F.lit(None).cast("double").alias("value")
        )
    return overall_rows(summary).select(
        "model_slug", F.lit(metric).alias("metric"), F.col(metric).alias("value")
    )


def metrics_long(summary: DataFrame, metrics=None) -> DataFrame:
    """Every metric of the overall rows as (model, metric, value)."""
    names = available(summary, metrics or METRICS)
    return summary.filter(F.col("track") == fixed.OVERALL).unpivot(
        ["model_slug"], names, "metric", "value"
    )


def pass_rates(summary: DataFrame) -> DataFrame:
    """One-shot and multi-shot pass rate per model, and the gap between them."""
    return overall_rows(summary).select(
        "model_slug",
        "one_shot_pass_rate",
        "multi_shot_pass_rate",
        (F.col("multi_shot_pass_rate") - F.col("one_shot_pass_rate")).alias("gap"),
    )


def track_grid(summary: DataFrame, tracks=fixed.TRACK_NAMES) -> DataFrame:
    """Composite by model and track, one column per track; a repeated cell is an error."""
    cells = summary.filter(F.col("track") != fixed.OVERALL)

    def cell(track: str):
        here = F.col("track") == track
        repeated = F.sum(F.when(here, 1)) > 1
        message = f"more than one {track} row for a model"
        value = F.max(F.when(here, F.col("composite")))
        return F.when(repeated, F.raise_error(message).cast("double")).otherwise(value).alias(track)

    return cells.groupBy("model_slug").agg(*(cell(t) for t in tracks)).orderBy("model_slug")


def _in_leaderboard_order(summary: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows re-ordered to the leaderboard; models without a row keep NULLs."""
    order = summary.filter(F.col("track") == fixed.OVERALL).select(
        "model_slug", F.col("composite").alias("_overall")
    )
    return order.join(rows, "model_slug", "left")


def category_composites(summary: DataFrame) -> DataFrame:
    """Mean composite of each model on component and on system tracks."""
    spark = summary.sparkSession
    categories = track_dimension(spark).select("track", "category")
    tracks = summary.filter(F.col("track") != fixed.OVERALL)
    mapped = tracks.join(categories, "track")
    means = mapped.groupBy("model_slug").agg(
        *(
            F.avg(F.when(F.col("category") == c, F.col("composite"))).alias(c)
            for c in ("component", "system")
        )
    )
    return (
        _in_leaderboard_order(summary, means)
        .orderBy(F.desc_nulls_last("_overall"), "model_slug")
        .drop("_overall")
    )


def track_profile(summary: DataFrame) -> DataFrame:
    """Composite of every model on every track, models in overall order throughout."""
    order = summary.filter(F.col("track") == fixed.OVERALL).select(
        "model_slug",
        F.row_number().over(W.orderBy(*_by_composite())).cast("long").alias("position"),
    )
    grid = track_grid(summary).unpivot(
        ["model_slug"], list(fixed.TRACK_NAMES), "track", "composite"
    )
    return order.join(grid, "model_slug", "left").orderBy("track", "position")


def pattern_matrix(scored: DataFrame) -> DataFrame:
    """Share of each technique per model on the advanced track, best adopters first."""
    flags = available(scored, [f"uses_{p}" for p in fixed.PATTERN_TECHNIQUES])
    rates = (
        scored.filter(F.col("track") == "e2e_advanced")
        .groupBy("model_slug")
        .agg(*(F.avg(truth(scored, c)).alias(c) for c in flags))
    )
    return rates.orderBy(*(F.desc_nulls_last(c) for c in flags), "model_slug")


def scorecard(summary: DataFrame) -> DataFrame:
    """The chosen overall metrics per model, best first."""
    shown = available(summary, fixed.SCORECARD_METRICS)
    return overall_rows(summary).select("model_slug", "tier", *shown)


def union_summaries(*summaries: DataFrame) -> DataFrame:
    """Summaries of several runs as one table; absent columns become NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), summaries)


def latest_per_model(summaries: DataFrame) -> DataFrame:
    """All rows of the newest run that contains each model; ties go to the larger run id.

    Aggregate and join back instead of a window, so a model with very many runs
    does not gather in one task.
    """
    newest = summaries.groupBy("model_slug").agg(
        F.max(F.struct("run_mtime", "run_id")).alias("_newest")
    )
    keys = newest.select("model_slug", F.col("_newest.run_id").alias("run_id"))
    return summaries.join(keys, ["model_slug", "run_id"]).orderBy(
        "track", F.desc_nulls_last("composite"), "model_slug"
    )


def models_not_in(summary: DataFrame, seen: DataFrame) -> DataFrame:
    """Models of one summary that another one does not have."""
    return summary.select("model_slug").distinct().join(
        seen.select("model_slug").distinct(), "model_slug", "left_anti"
    )


def run_difference(before: DataFrame, after: DataFrame, metrics=("composite",)) -> DataFrame:
    """Change of metrics between two runs, for groups in either."""
    keys = ["model_slug", "track"]
    old = before.select(*keys, *(F.col(m).alias(f"{m}_before") for m in metrics))
    new = after.select(*keys, *(F.col(m).alias(f"{m}_after") for m in metrics))
    joined = old.join(new, keys, "full")
    for m in metrics:
        joined = joined.withColumn(f"{m}_change", F.col(f"{m}_after") - F.col(f"{m}_before"))
    return joined.orderBy(*keys)
