"""Scoring and summaries that follow a growing folder of responses.

Scored rows of a micro-batch go to a folder of its own (``batch_id=N``) in overwrite mode, so a
batch that is repeated after a failure replaces itself. What earlier batches wrote is never touched.

Keys that are done, and the state of the running summary, are versions numbered by batch: a batch
starts from the version before its own number, whether it runs for the first time or again. The
summary's state is compact: one row of sums per (model, track, trial), and the distinct samples of
each (model, track) as bitmaps over dense numbers that a dictionary gives to sample ids. Both are
merged batch by batch and do not grow with the number of batches.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import fixed_values as fixed
from scorelake.operators.summary import GROUP, summary_from_stats, summary_order, trial_stats
from scorelake.sources.versions import Versions
from scorelake.streaming.seen_keys import SeenKeys

_KEY = list(fixed.KEY_COLUMNS)
#: Parts that numbers are dealt to sample ids in; numbers are dense in each.
PARTS = 64

Scorer = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Tables:
    """The folders of an incremental run."""

    root: str

    @property
    def scored(self) -> str:
        return f"{self.root}/scored"

    @property
    def keys(self) -> str:
        return f"{self.root}/keys"

    @property
    def state(self) -> str:
        return f"{self.root}/state"

    @property
    def progress(self) -> str:
        return f"{self.root}/progress"


def first_arrivals(rows: DataFrame, order: str) -> DataFrame:
    """One row per key: the first to arrive."""
    chosen = F.min_by(F.struct(*(c for c in rows.columns if c not in _KEY)), order).alias("_row")
    return rows.groupBy(*_KEY).agg(chosen).select(*_KEY, "_row.*")


def _numbered(samples: DataFrame, dictionary: DataFrame | None) -> DataFrame:
    """The dictionary (part, sample_id, number) with numbers for samples it does not have yet.

    New ids are numbered on from the last one of their part, part by part.
    """
    new = samples.select("sample_id").distinct()
    part = F.pmod(F.xxhash64("sample_id"), F.lit(PARTS)).cast("int")
    order = W.partitionBy("part").orderBy("sample_id")
    if dictionary is None:
        rank = F.row_number().over(order) - 1
        return new.withColumn("part", part).select("part", "sample_id", (rank.cast("long") * PARTS + F.col("part") + 1).alias("number"))
    new = new.join(dictionary, "sample_id", "left_anti").withColumn("part", part)
    used = dictionary.groupBy("part").agg(F.count(F.lit(1)).alias("used"))
    rank = F.coalesce("used", F.lit(0)) + F.row_number().over(order) - 1
    added = new.join(F.broadcast(used), "part", "left").select("part", "sample_id", (rank * PARTS + F.col("part") + 1).alias("number"))
    return dictionary.unionByName(added)


def _bitmaps(samples: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The samples of each (model, track) as bitmaps: model_slug, track, page, bits."""
    number = samples.join(dictionary.select("sample_id", "number"), "sample_id").withColumn("page", F.bitmap_bucket_number("number"))
    return number.groupBy("model_slug", "track", "page").agg(F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("bits"))


def _next_state(spark: SparkSession, tables: Tables, scored: DataFrame, batch_id: int) -> None:
    """Merges a batch's statistics and samples into the state before it."""
    state = Versions(spark, tables.state)
    before = state.latest(batch_id)
    old = None if before is None else state.folder(before)
    folder = state.new_folder()
    samples = scored.select("model_slug", "track", "sample_id").where("model_slug IS NOT NULL AND sample_id IS NOT NULL")
    known = None if old is None else spark.read.parquet(f"{old}/dictionary")
    _numbered(samples, known).write.parquet(f"{folder}/dictionary")
    bits = _bitmaps(samples, spark.read.parquet(f"{folder}/dictionary"))
    sums = trial_stats(scored)
    if old is not None:
        bits = bits.unionByName(spark.read.parquet(f"{old}/samples"))
        bits = bits.groupBy("model_slug", "track", "page").agg(F.bitmap_or_agg("bits").alias("bits"))
        sums = sums.unionByName(spark.read.parquet(f"{old}/statistics"), allowMissingColumns=True)
        sums = sums.groupBy(*GROUP).agg(*(F.sum(c).alias(c) for c in sums.columns if c not in GROUP))
    bits.write.parquet(f"{folder}/samples")
    sums.write.parquet(f"{folder}/statistics")
    state.publish({"folders": [folder]}, batch_id, again=batch_id in state.numbers())


def score_batch(tables: Tables, scorer: Scorer, order: str) -> Callable[[DataFrame, int], None]:
    """The batch function: score new keys only, keep keys and statistics."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = SeenKeys(spark, tables.keys, _KEY)
        new = keys.unseen(first_arrivals(batch, order), batch_id).rows
        scorer(new).write.mode("overwrite").parquet(f"{tables.scored}/batch_id={batch_id}")
        # Read back what was written, so later steps do not score again.
        scored = spark.read.parquet(f"{tables.scored}/batch_id={batch_id}")
        keys.add(scored, batch_id)
        _next_state(spark, tables, scored, batch_id)

    return run


def follow(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    tables: Tables,
    scorer: Scorer,
    order: str,
    fmt: str = "json",
) -> None:
    """Score everything that has arrived in the source folder since the last call."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = (
        stream.writeStream.foreachBatch(score_batch(tables, scorer, order))
        .option("checkpointLocation", tables.progress)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def scored_so_far(spark: SparkSession, tables: Tables) -> DataFrame:
    """All scored rows of the run."""
    return spark.read.option("basePath", tables.scored).parquet(f"{tables.scored}/batch_id=*")


def samples_seen(spark: SparkSession, tables: Tables) -> DataFrame:
    """Distinct samples per (model, track) and per model, counted from the state's bitmaps."""
    bits = spark.read.parquet(f"{Versions(spark, tables.state).folder()}/samples")
    overall = bits.groupBy("model_slug", F.lit(fixed.OVERALL).alias("track"), "page").agg(F.bitmap_or_agg("bits").alias("bits"))
    both = bits.where("track IS NOT NULL").unionByName(overall)
    return both.groupBy("model_slug", "track").agg(F.sum(F.bitmap_count("bits")).alias("n_samples"))


def running_summary(spark: SparkSession, tables: Tables, columns, rounded: bool = True) -> DataFrame:
    """The summary out of the state alone: the scored rows are not read again."""
    sums = spark.read.parquet(f"{Versions(spark, tables.state).folder()}/statistics")
    return summary_order(summary_from_stats(sums, samples_seen(spark, tables), columns, rounded=rounded))


def rescore_version(
    responses: DataFrame, scorer: Scorer, order: str, table: Versions, write: Callable[[DataFrame, str], None] | None = None
) -> int:
    """Scores every response again as the table's next version; readers of the current one go on.

    Removing a response and rescoring retries it.
    """
    return table.replace(scorer(first_arrivals(responses, order)), write)


def rescore(responses: DataFrame, scorer: Scorer, order: str, path: str) -> None:
    """Score every response again into a new folder; the old one stays as it is.

    Removing a response and rescoring retries it.
    """
    scorer(first_arrivals(responses, order)).write.mode("error").parquet(path)


def unique_stream(
    stream: DataFrame, event_time: str | None = None, delay: str = "1 day", keys: Sequence[str] = tuple(_KEY)
) -> DataFrame:
    """A stream without repeated keys.

    Without an event time the state keeps every key ever seen. With one, rows older than the
    watermark are dropped as late, and a key is forgotten once the watermark is ``delay`` past it.
    """
    if event_time is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(list(keys))


def append_unique(stream: DataFrame, path: str, progress: str) -> int:
    """Appends what has arrived on a stream to a folder; returns how many keys its state holds afterwards."""
    query = (
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", progress)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    last = query.lastProgress
    return sum(o["numRowsTotal"] for o in last["stateOperators"]) if last else 0
