"""The self-repair loop as data: attempts rolled up to responses, and next requests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.functions.prompting import retry_messages
from scorelake.functions.values import round_half_even

_KEY = list(fixed.KEY_COLUMNS)
_FAILED = "coalesce(error, '') <> ''"


def last_attempts(attempts: DataFrame, shots: int) -> DataFrame:
    """The attempt each task ends on: the first pass, the first error, or the last shot."""
    ends = F.expr(f"if(passed OR {_FAILED}, attempt, NULL)")
    return attempts.groupBy(*_KEY).agg(
        F.coalesce(F.least(F.min(ends), F.lit(shots)), F.lit(shots)).alias("_last")
    )


def roll_up(attempts: DataFrame, shots: int) -> DataFrame:
    """One response per task: summed usage and the last output up to its end.

    A minimum per key and a join back instead of a window: only key and flags are
    aggregated first, the texts are shuffled once. A failed call adds no usage and
    no output.
    """
    kept = attempts.join(last_attempts(attempts, shots), _KEY).filter("attempt <= _last")
    ok = f"NOT ({_FAILED})"
    rolled = kept.groupBy(*_KEY).agg(
        F.max("attempt").alias("attempts"),
        *(
            F.expr(f"coalesce(sum(if({ok}, {c}, NULL)), 0)").alias(c)
            for c in ("tokens_in", "tokens_out", "latency_s", "cost")
        ),
        F.expr("coalesce(max_by(error, attempt), '')").alias("error"),
        F.expr(f"coalesce(max_by(raw_output, if({ok}, attempt, NULL)), '')").alias("raw_output"),
    )
    return rolled.withColumns(
        {"latency_s": round_half_even("latency_s", 3), "cost": round_half_even("cost", 6)}
    )


def next_requests(attempts: DataFrame, shots: int) -> DataFrame:
    """Requests of the next round: failed attempts that have a shot left."""
    due = attempts.filter(f"NOT passed AND NOT ({_FAILED}) AND attempt < {shots:d}")
    return due.select(
        *_KEY,
        (F.col("attempt") + 1).alias("attempt"),
        retry_messages(F.col("messages"), F.col("raw_output"), F.col("feedback")).alias("messages"),
    )
