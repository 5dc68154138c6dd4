"""Selection of models and tracks, the task plan, and resuming by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import fixed_values as fixed
from scorelake import schemas
from scorelake.functions.prompting import call_cost
from scorelake.functions.values import required

#: Samples of one track and salt that one task holds, about.
SALT_ROWS = 65536
#: Samples whose tasks one Spark task writes down, about: each is a row per model and trial.
TASK_SAMPLES = 512
_KEY_SCHEMA = [f for f in schemas.RESPONSES.fields if f.name in fixed.KEY_COLUMNS]


def with_labels(models: DataFrame) -> DataFrame:
    """Label defaults to the slug."""
    return models.withColumn("label", F.expr("coalesce(nullif(label, ''), slug)"))


def _requested(spark: SparkSession, selector: str) -> DataFrame:
    wanted = [name.strip() for name in selector.split(",") if name.strip()]
    return spark.createDataFrame(list(enumerate(wanted)), "position int, wanted string")


def select_models(models: DataFrame, selector: str) -> DataFrame:
    """``*`` is every model, ``all`` those not skipped by default, else a slug list.

    A list keeps its own order in ``position``; an unknown slug is an error.
    """
    if selector == "*":
        return models
    if selector == "all":
        return models.filter(~F.coalesce(F.col("skip_by_default"), F.lit(False)))
    requested = _requested(models.sparkSession, selector)
    found = requested.join(models, F.col("wanted") == F.col("slug"), "left")
    known = required(found, F.col("slug").isNotNull(), F.concat(F.lit("Unknown model slug: "), F.col("wanted")))
    return known.drop("wanted").orderBy("position")


def track_names(selector: str) -> list[str]:
    """Names of the selected tracks, for callers that plan by name."""
    if selector == "all":
        return list(fixed.TRACK_NAMES)
    names = [name.strip() for name in selector.split(",") if name.strip()]
    unknown = [n for n in names if n not in fixed.TRACK_NAMES]
    if unknown:
        raise KeyError(f"Unknown track: {', '.join(unknown)}")
    return names


def select_tracks(tracks: DataFrame, selector: str) -> DataFrame:
    """Every track, or those of a name list in its order; an unknown name is an error."""
    if selector == "all":
        return tracks
    requested = _requested(tracks.sparkSession, selector)
    found = requested.join(tracks, F.col("wanted") == F.col("track"), "left")
    known = required(found, F.col("track").isNotNull(), F.concat(F.lit("Unknown track: "), F.col("wanted")))
    return known.drop("wanted").orderBy("position")


def unknown_names(names: DataFrame, known: DataFrame, column: str) -> DataFrame:
    """Names that the known table does not have."""
    return names.select(column).distinct().join(known.select(column), column, "left_anti")


def _salts(samples: DataFrame) -> int:
    """Into how many parts each track's samples are dealt; follows from their number."""
    return _parts(samples.count(), SALT_ROWS)


def _parts(rows: int, each: int) -> int:
    return max(1, -(-rows // each))


def first_samples(samples: DataFrame, limit: int, order: str = "sample_id") -> DataFrame:
    """The first ``limit`` samples of each track, by id.

    Ranked within (track, salt) first, so a track with most of the samples is cut
    down in many tasks before its survivors meet in one.
    """
    salted = samples.withColumn("_salt", F.pmod(F.xxhash64("track", order), F.lit(_salts(samples))))
    near = W.partitionBy("track", "_salt").orderBy(order)
    final = W.partitionBy("track").orderBy(order)
    return (
        salted.withColumn("_rank", F.row_number().over(near))
        .filter(F.col("_rank") <= limit)
        .withColumn("_rank", F.row_number().over(final))
        .filter(F.col("_rank") <= limit)
        .drop("_rank", "_salt")
    )


def plan_tasks(
    models: DataFrame,
    samples: DataFrame,
    tracks=fixed.TRACK_NAMES,
    trials: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """One task per model, sample and trial of the selected tracks.

    Every model runs on every selected track, so the plan is an equi-join on the
    track. The six track names alone would be skewed join keys: models (few rows)
    are repeated per salt and samples spread over the salts. Samples are few bytes but
    many pairs, so they are dealt by their number, not by their size as files or blocks.
    """
    if trials < 1:
        return models.sparkSession.createDataFrame([], T.StructType(list(_KEY_SCHEMA)))
    if limit is not None:
        samples = first_samples(samples, limit)
    n_samples = samples.count()
    n_salts, n_tasks = _parts(n_samples, SALT_ROWS), _parts(n_samples, TASK_SAMPLES)
    salts = F.explode(F.sequence(F.lit(0), F.lit(n_salts - 1))).alias("_salt")
    per_track = models.select("slug", salts).withColumn(
        "track", F.explode(F.array(*(F.lit(t) for t in tracks)))
    )
    spread = samples.repartition(n_tasks).withColumn(
        "_salt", F.pmod(F.xxhash64("sample_id"), F.lit(n_salts)).cast("int")
    )
    trial = F.explode(F.sequence(F.lit(0), F.lit(trials - 1))).alias("trial")
    return spread.join(per_track, ["track", "_salt"]).select(
        F.col("slug").alias("model_slug"), "track", "sample_id", trial
    )


def task_counts(
    models: DataFrame,
    samples: DataFrame,
    tracks=fixed.TRACK_NAMES,
    trials: int = 1,
    limit: int | None = None,
) -> DataFrame:
    """Planned tasks per model, track and trial, and their distinct samples.

    Counts the samples of each track once, at most one row per track, instead of
    writing down the pairs.
    """
    if limit is not None:
        samples = first_samples(samples, limit)
    sizes = samples.filter(F.col("track").isin(*tracks)).groupBy("track").agg(
        F.count(F.lit(1)).alias("n_tasks"), F.count_distinct("sample_id").alias("n_samples")
    )
    per_track = models.select("slug", F.explode(F.array(*(F.lit(t) for t in tracks))).alias("track"))
    every = F.sequence(F.lit(0), F.lit(trials - 1)) if trials > 0 else F.array().cast("array<int>")
    return per_track.join(sizes, "track").select(
        F.col("slug").alias("model_slug"), "track", F.explode(every).alias("trial"), "n_tasks", "n_samples"
    )


def total_tasks(counts: DataFrame) -> DataFrame:
    """Number of planned tasks out of ``task_counts``, one row."""
    return counts.agg(F.coalesce(F.sum("n_tasks"), F.lit(0)).alias("total_tasks"))


def without_done(rows: DataFrame, done: DataFrame) -> DataFrame:
    """Rows whose key is not in ``done``: pending tasks, or responses not yet scored."""
    keys = done.select(*fixed.KEY_COLUMNS)
    return rows.join(keys, list(fixed.KEY_COLUMNS), "left_anti")


def with_cost(usage: DataFrame, models: DataFrame) -> DataFrame:
    """Adds the dollar cost of each call from the model's prices."""
    prices = models.select(
        F.col("slug").alias("model_slug"), "input_cost_per_mtok", "output_cost_per_mtok"
    )
    cost = call_cost(
        F.col("tokens_in"),
        F.col("tokens_out"),
        F.col("input_cost_per_mtok"),
        F.col("output_cost_per_mtok"),
    )
    return (
        usage.join(prices, "model_slug", "left")
        .withColumn("cost", cost)
        .drop("input_cost_per_mtok", "output_cost_per_mtok")
    )
