"""The summary: every metric per (model, track) and per model, with trial spread.

One pass over the scored table builds per-trial statistics, one row per (model,
track, trial); a second pass over three columns counts distinct samples. Everything
after that works on those few rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.functions.values import round_half_even
from scorelake.operators.metrics import METRICS, Metric, Stats, sample_counts, tier, with_levels
from scorelake.schemas import summary_schema

GROUP = ("model_slug", "track", "trial")


def _is_headline() -> Column:
    return F.col("track").isin(*fixed.HEADLINE_TRACKS)


def _plan(columns, metrics: dict[str, Metric] | None) -> tuple[Stats, list[str]]:
    """The statistics behind a registry, and its metric names with the composite."""
    names = list(METRICS if metrics is None else metrics)
    if "composite" not in names:
        names.insert(0, "composite")
    return Stats(columns, metrics).use_all(names), names


def trial_stats(scored: DataFrame, metrics: dict[str, Metric] | None = None) -> DataFrame:
    """Mergeable statistics per (model, track, trial): the one pass over the facts."""
    stats, _ = _plan(scored.columns, metrics)
    if "trial" not in scored.columns:
        scored = scored.withColumn("trial", F.lit(None).cast("int"))
    return (
        scored.filter(F.col("model_slug").isNotNull())
        .groupBy(*GROUP)
        .agg(*stats.aggregates(scored))
    )


def trial_composites(per_trial: DataFrame, columns) -> DataFrame:
    """Statistics with the composite of each (model, track, trial)."""
    return Stats(columns).use_all(["composite"]).with_metrics(per_trial)


def summary_from_stats(
    per_trial: DataFrame,
    counts: DataFrame,
    columns,
    metrics: dict[str, Metric] | None = None,
    rounded: bool = True,
) -> DataFrame:
    """Summary rows out of per-trial statistics and distinct sample counts.

    ``columns`` are the columns of the scored table behind the statistics.
    """
    stats, names = _plan(columns, metrics)
    sums = list(stats.sums)

    # Per-trial composite of the track, and per-trial mean over headline tracks.
    by_trial = W.partitionBy("model_slug", "trial")
    trials = trial_composites(per_trial, columns).select(
        *GROUP, *sums, F.expr("if(trial IS NULL, NULL, composite)").alias("_own")
    )
    trials = trials.withColumns(
        {
            "_headline": F.avg(F.when(_is_headline(), F.col("_own"))).over(by_trial),
            "_first": F.row_number().over(by_trial.orderBy("track")) == 1,
        }
    )
    spread = F.expr(
        f"CASE WHEN track <> '{fixed.OVERALL}' THEN _own "
        "WHEN _first AND trial IS NOT NULL THEN _headline END"
    )
    merged = (
        with_levels(trials)
        .withColumn("_spread", spread)
        .groupBy("model_slug", "track")
        .agg(
            *stats.merges(),
            F.expr("greatest(count(_spread), 1)").alias("n_trials"),
            F.stddev_samp("_spread").alias("composite_std"),
        )
    )
    counted = merged.join(counts, ["model_slug", "track"], "left").withColumn(
        "n_samples", F.expr("coalesce(n_samples, 0)")
    )

    # The overall composite is the mean of the headline tracks' composites.
    by_model = W.partitionBy("model_slug")
    measured = (
        stats.with_metrics(counted)
        .select("model_slug", "track", "n_samples", "n_trials", *names, "composite_std")
        .withColumn(
            "_headline", F.avg(F.when(_is_headline(), F.col("composite"))).over(by_model)
        )
        .withColumn(
            "composite", F.expr(f"if(track = '{fixed.OVERALL}', _headline, composite)")
        )
    )
    # A track's tier follows the rounded composite, the overall tier the exact one.
    graded = measured.withColumn("_rounded", round_half_even("composite", 4)).withColumn(
        "tier", tier(F.expr(f"if(track = '{fixed.OVERALL}', composite, _rounded)"))
    )
    if rounded:
        graded = graded.withColumns({c: round_half_even(c, 4) for c in (*names, "composite_std")})
    return graded.select(
        "model_slug", "track", "n_samples", "n_trials", *names, "composite_std", "tier"
    )


def summarize(
    scored: DataFrame, metrics: dict[str, Metric] | None = None, rounded: bool = True
) -> DataFrame:
    """The full summary, ordered by track, then best composite first."""
    summary = summary_from_stats(
        trial_stats(scored, metrics), sample_counts(scored), scored.columns, metrics, rounded
    )
    return summary_order(summary)


def summary_order(summary: DataFrame) -> DataFrame:
    """Track ascending, composite descending with gaps last, ties by model."""
    return summary.orderBy("track", F.desc_nulls_last("composite"), "model_slug")


def _composites(scored: DataFrame, keys, rows: Column) -> DataFrame:
    """Composite per group of the chosen rows."""
    stats = Stats(scored.columns).use_all(["composite"])
    grouped = scored.filter(rows).groupBy(*keys).agg(*stats.aggregates(scored))
    return stats.with_metrics(grouped).select(*keys, "composite")


def headline_composite(scored: DataFrame) -> DataFrame:
    """Mean composite over the headline tracks of each model."""
    rows = F.col("model_slug").isNotNull() & _is_headline()
    per_track = _composites(scored, ("model_slug", "track"), rows)
    return per_track.groupBy("model_slug").agg(F.avg("composite").alias("composite"))


def _spread(per_trial: DataFrame, *keys: str) -> DataFrame:
    return per_trial.groupBy(*keys).agg(
        F.expr("greatest(count(composite), 1)").alias("n_trials"),
        F.stddev_samp("composite").alias("composite_std"),
    )


def trial_spread(scored: DataFrame) -> DataFrame:
    """Trials with a composite, and their sample deviation, per (model, track)."""
    rows = F.expr("model_slug IS NOT NULL AND track IS NOT NULL AND trial IS NOT NULL")
    return _spread(_composites(scored, GROUP, rows), "model_slug", "track")


def headline_spread(scored: DataFrame) -> DataFrame:
    """Trials and deviation of the per-trial headline composite, per model."""
    rows = F.expr("model_slug IS NOT NULL AND trial IS NOT NULL") & _is_headline()
    per_trial = _composites(scored, GROUP, rows).groupBy("model_slug", "trial")
    return _spread(per_trial.agg(F.avg("composite").alias("composite")), "model_slug")


def empty_summary(spark, metrics: dict[str, Metric] | None = None) -> DataFrame:
    """A summary without rows, with the declared columns."""
    return spark.createDataFrame([], summary_schema(metrics or METRICS))
