"""Judge requests and replies: building, de-duplicating, replaying, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.dimensions import judge_dimension
from scorelake.functions import judging
from scorelake.functions.parsing import with_judge_json

_KEY = list(fixed.KEY_COLUMNS)

# Every track has one judge; unit tests have the hallucination check besides.
MAIN_JUDGE = {t: j for t, j in fixed.JUDGES_BY_TRACK if j != "hallucination"}
SIDE_JUDGE = {t: j for t, j in fixed.JUDGES_BY_TRACK if j == "hallucination"}


def judges_of(rows: DataFrame) -> DataFrame:
    """Each row once per judge of its track."""
    return rows.join(judge_dimension(rows.sparkSession), "track")


def _judge_name(judges: dict[str, str]) -> Column:
    cases = " ".join(f"WHEN '{track}' THEN '{judge}'" for track, judge in judges.items())
    return F.expr(f"CASE track {cases} END")


def with_request_keys(rows: DataFrame, model_id: str) -> DataFrame:
    """Adds the request key of the track's judge and of the hallucination check.

    ``rows`` holds ``payload`` and ``parsed``. A row without such a judge gets a key
    of its own that no reply has, so missing keys do not pile up in one partition.
    """
    model = F.lit(model_id)

    def key(judges: dict[str, str]) -> Column:
        name = _judge_name(judges)
        made = judging.judge_request_key(model, name, F.col("payload"), F.col("parsed"))
        own = F.concat(F.lit("none:"), F.xxhash64(*_KEY).cast("string"))
        return F.when(name.isNotNull(), made).otherwise(own)

    return rows.withColumns({"_main_key": key(MAIN_JUDGE), "_side_key": key(SIDE_JUDGE)})


def judge_requests(rows: DataFrame, model_id: str) -> DataFrame:
    """The distinct judge requests of the rows, with how many rows share each.

    Rows are counted by judge and artifact, which is what differs between prompts; messages and keys are made
    of what is left. No judge's fixed part begins like another's, so different pairs are different requests,
    but for prompts without an artifact, of which there is one per system message.
    """
    judge = F.col("judge")
    shown = judges_of(rows).select(judge, judging.judged_artifact(judge, F.col("payload"), F.col("parsed")).alias("artifact"))
    alike = F.when(F.col("artifact").isNotNull() | (judge == "hallucination"), judge).otherwise(F.lit("review"))
    asked = shown.withColumn("judge", alike).groupBy("judge", "artifact").agg(F.count(F.lit(1)).alias("n_rows"))
    messages = asked.select(judging.artifact_messages(judge, F.col("artifact")).alias("messages"), "n_rows")
    return messages.select(judging.request_key(F.lit(model_id), F.col("messages")).alias("request_key"), "messages", "n_rows")


def distinct_requests(keyed: DataFrame) -> DataFrame:
    """One row per request key; equal keys carry equal messages, so any of them will do."""
    return keyed.groupBy("request_key").agg(
        F.any_value("messages").alias("messages"), F.count(F.lit(1)).alias("n_rows")
    )


def read_replies(replies: DataFrame) -> DataFrame:
    """Typed fields of each distinct reply: small columns, parsed once per reply.

    A failed reply (NULL text) reads as an empty object. Of repeated keys the last reply
    counts, by ``ingest_seq``; a table without that column should hold each key once, and
    gives the greatest text otherwise.
    """
    last = F.expr("max_by(reply, ingest_seq)") if "ingest_seq" in replies.columns else F.max("reply")
    unique = replies.groupBy("request_key").agg(last.alias("reply"))
    parsed = with_judge_json(unique, "reply", "_json").drop("reply")
    read = judging.with_rubric_reply(parsed, "_json")
    read = judging.with_review_reply(judging.with_hallucination_reply(read, "_json"), "_json")
    return read.drop("_json")


def with_judgements(keyed: DataFrame, replies: DataFrame) -> DataFrame:
    """Adds every judge column to rows with request keys; unmatched requests read as ``{}``.

    Only the typed reply fields travel. The joins are left joins on a hash key, so
    the optimizer may split a request that very many rows share.
    """
    fields = read_replies(replies)
    reply_columns = [c for c in fields.columns if c != "request_key"]
    main = fields.select(
        F.col("request_key").alias("_main_key"),
        F.lit(True).alias("_found"),
        *(F.col(c).alias(f"_main_{c}") for c in reply_columns),
    )
    side = fields.select(
        F.col("request_key").alias("_side_key"),
        F.col("flag").alias("_side_flag"),
        F.col("note").alias("_side_note"),
    )
    joined = (
        keyed.join(main, "_main_key", "left")
        .join(side, "_side_key", "left")
        .withColumns({"_judge": _judge_name(MAIN_JUDGE), "_side": _judge_name(SIDE_JUDGE)})
    )
    # A found NULL score is a NaN reply and stays NULL; a missing reply scores 0.
    score, note = "if(_found, _main_score, 0D)", "coalesce(_main_note, '')"
    design = "_judge IN ('design', 'test_case_design')"
    explained = "_judge = 'explanation'"
    columns = {
        "hallucinated": "if(_side IS NULL, NULL, coalesce(_side_flag, false))",
        "hallucination_note": "if(_side IS NULL, NULL, coalesce(_side_note, ''))",
        "design_judge": f"if({design}, {score}, NULL)",
        "design_note": f"if({design}, {note}, NULL)",
        "explanation_judge": f"if({explained}, {score}, NULL)",
        "explanation_note": f"if({explained}, {note}, NULL)",
        "_design_passed": f"if(_judge = 'test_case_design', {score} >= {fixed.DESIGN_PASS}D, NULL)",
    }
    for name in fixed.JUDGE_COLUMNS["review"]:
        missing = "''" if name.endswith("_note") else "0D"
        columns[name] = f"if(_judge = 'review', if(_found, _main_{name}, {missing}), NULL)"
    rated = joined.withColumns({n: F.expr(text) for n, text in columns.items()})
    scratch = [c for c in rated.columns if c.startswith("_") and c != "_design_passed"]
    return rated.drop(*scratch)


def latest_raw_outputs(responses: DataFrame) -> DataFrame:
    """The raw output of each key; of repeated keys the last to arrive counts."""
    return responses.groupBy(*_KEY).agg(
        F.expr("coalesce(max_by(raw_output, ingest_seq), '')").alias("raw_output")
    )


def with_raw_outputs(scored: DataFrame, responses: DataFrame) -> DataFrame:
    """Scored rows with their raw output; a row without a response gets ''."""
    joined = scored.join(latest_raw_outputs(responses), _KEY, "left")
    return joined.withColumn("raw_output", F.coalesce(F.col("raw_output"), F.lit("")))


def judge_columns() -> list[str]:
    """The columns owned by judges; ``passed`` is shared with execution."""
    owned = [c for cols in fixed.JUDGE_COLUMNS.values() for c in cols if c != "passed"]
    return list(dict.fromkeys(owned))


def drop_stale(scored: DataFrame) -> DataFrame:
    """Rows without error columns and without judge values their track no longer has.

    Columns of review criteria that are no longer asked for go with the errors.
    """
    owners = {
        column: [t for t, j in fixed.JUDGES_BY_TRACK if column in fixed.JUDGE_COLUMNS[j]]
        for column in judge_columns()
    }
    outdated = [c for c in scored.columns if c.startswith("review_") and c not in owners]
    kept = [c for c in scored.columns if not c.endswith("_error") and c not in outdated]
    return scored.select(
        *(
            F.when(F.col("track").isin(*owners[c]), F.col(c)).alias(c) if c in owners else c
            for c in kept
        )
    )


def merge_fresh(scored: DataFrame, fresh: DataFrame, columns, keys=tuple(_KEY)) -> DataFrame:
    """Fresh columns over older ones, NULL or not; a row without a fresh one stays as it is."""
    new = fresh.select(*keys, F.lit(True).alias("_fresh"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    joined = scored.join(new, list(keys), "left")
    old = set(scored.columns)
    merged = {
        c: F.when(F.col("_fresh"), F.col(f"_new_{c}")).otherwise(F.col(c)) if c in old else F.col(f"_new_{c}")
        for c in columns
    }
    return joined.withColumns(merged).drop("_fresh", *(f"_new_{c}" for c in columns))
