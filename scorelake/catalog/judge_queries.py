"""Execution logs, judge replies, merging and re-judging queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed

from scorelake.catalog import bindings
from scorelake.catalog.bindings import with_bindings
from scorelake.functions import execution, judging, parsing
from scorelake.functions.localization import localization_pass
from scorelake.functions.prompting import chat_reply
from scorelake.operators import rejudge

QUERIES: dict = {}
SQL: dict[str, str] = {}
_KEY = ", ".join(fixed.KEY_COLUMNS)

# --- Execution logs -------------------------------------------------------------

_BLOB = """WITH blobs AS (SELECT *, event_id % 11 <> 0 AND event_id % 13 <> 0 AS ok FROM v_exec)"""


def runner_logs(spark, sf_dir):
    """Fields of the runner's JSON line, NULL when the log has none."""
    logs = bindings.exec_results(spark, sf_dir)
    blob = logs.select("event_id", execution.runner_blob(F.col("stdout")).alias("blob"))
    return blob.select(
        "event_id",
        *(F.col(f"blob.{c}").alias(c) for c in ("tests_total", "collection_ok", "coverage_pct", "mutants_killed")),
    )


SQL["runner_logs"] = with_bindings(
    "exec",
    f"""{_BLOB} SELECT event_id, CASE WHEN ok THEN CAST(event_id % 6 AS DOUBLE) END AS tests_total, CASE WHEN ok THEN event_id % 5 <> 0 END AS collection_ok,
          CASE WHEN ok AND event_id % 7 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS coverage_pct,
          CASE WHEN ok THEN CAST(event_id % 5 AS DOUBLE) END AS mutants_killed FROM blobs""",
)


def unit_verdicts(spark, sf_dir):
    """Unit-test columns of a scored row, with the failure defaults."""
    logs = bindings.exec_results(spark, sf_dir)
    logs = execution.with_blob(logs, "stdout")
    verdict = execution.unit_verdict("stdout", "stderr", "4")
    return logs.select("event_id", *(c.alias(n) for n, c in verdict.items()))


_VALID = "ok AND event_id % 5 <> 0 AND event_id % 2 = 0 AND event_id % 6 > 0"
SQL["unit_verdicts"] = with_bindings(
    "exec",
    f"""{_BLOB} SELECT event_id, ok AS exec_ok, CAST(CASE WHEN ok THEN event_id % 6 ELSE 0 END AS INTEGER) AS tests_total,
          CAST(CASE WHEN ok THEN event_id % 2 ELSE 0 END AS INTEGER) AS tests_failing_on_correct, CAST(4 AS INTEGER) AS mutants_total,
          CAST(CASE WHEN ok THEN event_id % 5 END AS INTEGER) AS mutants_killed,
          CAST(CASE WHEN ok THEN 4 - event_id % 5 ELSE 4 END AS INTEGER) AS mutants_surviving,
          CASE WHEN ok AND event_id % 7 <> 0 THEN CAST(event_id % 100 AS DOUBLE) ELSE 0.0::DOUBLE END AS coverage_pct,
          {_VALID} AS runs_and_valid, {_VALID} AS passed,
          CASE WHEN NOT ok THEN right(CASE WHEN stderr <> '' THEN stderr ELSE stdout END, 500) END AS exec_error FROM blobs""",
)


def unit_feedback(spark, sf_dir):
    """Feedback text of each unit-test run."""
    logs = bindings.exec_results(spark, sf_dir)
    logs = execution.with_blob(logs, "stdout")
    verdict = execution.unit_verdict("stdout", "stderr", "4")
    judged = logs.select("event_id", *(c.alias(n) for n, c in verdict.items()))
    columns = {n: F.col(n) for n in verdict}
    return judged.select("event_id", execution.unit_feedback(columns).alias("feedback"))


SQL["unit_feedback"] = with_bindings(
    "exec",
    f"""{_BLOB} SELECT event_id, CASE WHEN {_VALID} THEN ''
          WHEN NOT ok THEN 'The test suite failed to run:' || chr(10) || right(CASE WHEN stderr <> '' THEN stderr ELSE stdout END, 500)
          ELSE CAST(event_id % 2 AS VARCHAR) || ' of your tests fail against the correct implementation. Your tests must pass on correct code. Fix the assertions/imports.' END AS feedback
        FROM blobs""",
)


def test_tallies(spark, sf_dir):
    """Counts from a text summary, with and without the doubled errors."""
    logs = bindings.exec_results(spark, sf_dir)
    plain = execution.test_tally(F.col("tally"))
    doubled = execution.test_tally(F.col("tally"), double_count_errors=True)
    return logs.select(
        "event_id",
        *(c.alias(n) for n, c in plain.items()),
        doubled["n_total"].alias("n_total_doubled"),
    )


SQL["test_tallies"] = with_bindings(
    "exec",
    """SELECT event_id, CAST(event_id % 9 AS INTEGER) AS n_passed, CAST(event_id % 4 AS INTEGER) AS n_failed, CAST(event_id % 3 AS INTEGER) AS n_errors,
         CAST(event_id % 9 + event_id % 4 + event_id % 3 AS INTEGER) AS n_total, CAST(event_id % 4 + event_id % 3 AS INTEGER) AS n_failing,
         CAST(event_id % 9 + event_id % 4 + 2 * (event_id % 3) AS INTEGER) AS n_total_doubled FROM v_exec""",
)


def browser_verdicts(spark, sf_dir):
    """Ran, passed and note of each browser run."""
    logs = bindings.exec_results(spark, sf_dir)
    verdict = execution.browser_verdict(
        F.col("exit_code"), F.col("timed_out"), F.col("stdout"), F.col("stderr")
    )
    return logs.select("event_id", *(c.alias(n) for n, c in verdict.items()))


SQL["browser_verdicts"] = with_bindings(
    "exec",
    """WITH ran AS (SELECT *, exit_code IN (0, 1) AND NOT timed_out AS ok FROM v_exec)
       SELECT event_id, ok AS e2e_ran, ok AND exit_code = 0 AS e2e_passed, ok AND exit_code = 0 AS passed,
         CASE WHEN ok THEN '' ELSE right(CASE WHEN stderr <> '' THEN stderr ELSE stdout END, 200) END AS e2e_note FROM ran""",
)


def text_tails(spark, sf_dir):
    """Last 500, first 200 and first 160 characters of every document."""
    text = F.col("text")
    return bindings.table(spark, sf_dir, "documents").select(
        "doc_id",
        execution.tail(text, fixed.EXEC_ERROR_CHARS).alias("exec_error"),
        execution.head(text, fixed.JUDGE_NOTE_CHARS).alias("judge_note"),
        execution.head(text, fixed.REVIEW_NOTE_CHARS).alias("review_note"),
    )


SQL["text_tails"] = """
SELECT doc_id, right(text, 500) AS exec_error, left(text, 200) AS judge_note, left(text, 160) AS review_note FROM documents"""


def gateway_scripts(spark, sf_dir):
    """Pages with their base-URL token filled and local hosts rewritten."""
    pages = bindings.table(spark, sf_dir, "pages")
    script = F.concat(
        F.lit("__BASE_URL__/a localhost:80 127.0.0.1/x localhost "), F.col("html"), F.lit(" __BASE_URL__")
    )
    return pages.select(
        "page_id",
        execution.gateway_script(script, F.lit("http://localhost:8081")).alias("script"),
        execution.reset_url(F.concat("url", F.lit("//"))).alias("reset_url"),
    )


SQL["gateway_scripts"] = r"""
SELECT page_id, regexp_replace(replace('__BASE_URL__/a localhost:80 127.0.0.1/x localhost ' || html || ' __BASE_URL__', '__BASE_URL__', 'http://localhost:8081'),
    '(localhost|127\.0\.0\.1)([:/])', 'host.docker.internal\2', 'g') AS script,
  rtrim(url, '/') || '/api/reset' AS reset_url FROM pages"""


def transient_failures(spark, sf_dir):
    """Which stored failures are worth a retry."""
    logs = bindings.exec_results(spark, sf_dir)
    return logs.select(
        "event_id", execution.is_transient(F.col("status"), F.col("error")).alias("transient")
    )


SQL["transient_failures"] = with_bindings(
    "exec",
    """SELECT event_id, coalesce(status = 429 OR status BETWEEN 500 AND 599, regexp_matches(error, '(?i)transport|timeout|connect')) AS transient
       FROM v_exec""",
)


def usage_replies(spark, sf_dir):
    """Text and token counts out of stored chat replies."""
    key = F.col("doc_id")
    content = F.to_json(F.struct(F.col("text").alias("content")))
    usage = F.when(
        key % 3 != 0,
        F.concat(F.lit(', "usage": {"prompt_tokens": '), (key % 50).cast("string"),
                 F.when(key % 3 == 1, F.lit("}")).otherwise(F.lit(', "completion_tokens": 7}'))),
    ).otherwise("")
    reply = F.concat(F.lit('{"choices": [{"message": '), content, F.lit("}]"), usage, F.lit("}"))
    replies = bindings.table(spark, sf_dir, "documents").select("doc_id", reply.alias("reply"))
    read = chat_reply(F.col("reply"))
    return replies.select("doc_id", *(c.alias(n) for n, c in read.items()))


SQL["usage_replies"] = """
SELECT doc_id, text, CASE WHEN doc_id % 3 <> 0 THEN doc_id % 50 ELSE 0 END AS tokens_in,
  CAST(CASE WHEN doc_id % 3 = 2 THEN 7 ELSE 0 END AS BIGINT) AS tokens_out FROM documents"""


def localization_verdicts(spark, sf_dir):
    """Pass rule of bug localization: exact, or near with a working repair."""
    key = F.col("event_id")
    exact, near = key % 3 == 0, key % 2 == 0
    repair = F.when(key % 5 != 0, key % 7 < 3)
    return bindings.table(spark, sf_dir, "events").select(
        "event_id", localization_pass(exact, near, repair).alias("passed")
    )


SQL["localization_verdicts"] = """
SELECT event_id, event_id % 3 = 0 OR (event_id % 2 = 0 AND event_id % 5 <> 0 AND event_id % 7 < 3) AS passed FROM events"""

# --- Judge replies --------------------------------------------------------------


def _documents(spark, sf_dir) -> DataFrame:
    given = bindings.replies(spark, sf_dir)
    return parsing.with_judge_json(given, "reply", "document").select("doc_id", "document")


def judge_scores(spark, sf_dir):
    """Clamped score and pass verdict of each reply."""
    scored = judging.with_rubric_reply(_documents(spark, sf_dir), "document").drop("document")
    return scored.withColumn("passed", F.col("score") >= fixed.DESIGN_PASS)


SQL["judge_scores"] = with_bindings(
    "replies",
    """WITH given AS (SELECT *, valid AS readable FROM v_replies)
       SELECT doc_id, CASE WHEN readable THEN score ELSE 0.0::DOUBLE END AS score,
         CASE WHEN readable THEN left(text, 200) ELSE '' END AS note,
         CASE WHEN readable THEN score ELSE 0.0::DOUBLE END >= 0.5 AS passed FROM given""",
)


def hallucination_flags(spark, sf_dir):
    """Truthiness of each reply's flag."""
    flagged = judging.with_hallucination_reply(_documents(spark, sf_dir), "document")
    return flagged.select("doc_id", F.col("flag").alias("hallucinated"))


SQL["hallucination_flags"] = with_bindings(
    "replies", "SELECT doc_id, valid AND flag AS hallucinated FROM v_replies"
)


def review_scores(spark, sf_dir):
    """Per-criterion scores and notes with their mean; missing criteria score 0."""
    return judging.with_review_reply(_documents(spark, sf_dir), "document").drop("document")


SQL["review_scores"] = with_bindings(
    "replies",
    """WITH given AS (SELECT *, valid AS r FROM v_replies),
       parts AS (SELECT doc_id, r, CASE WHEN r THEN (doc_id % 9) / 8.0::DOUBLE ELSE 0 END AS a, CASE WHEN r AND doc_id % 2 = 0 THEN 0.25::DOUBLE ELSE 0 END AS w,
         CASE WHEN r THEN 0.5::DOUBLE ELSE 0 END AS e FROM given)
       SELECT doc_id, a AS review_readability, CASE WHEN r THEN 'n' || CAST(doc_id % 3 AS VARCHAR) ELSE '' END AS review_readability_note,
         0.0::DOUBLE AS review_idiomatic_playwright, '' AS review_idiomatic_playwright_note, w AS review_waiting_layer,
         CASE WHEN r AND doc_id % 2 = 0 THEN 'w' ELSE '' END AS review_waiting_layer_note, e AS review_eloquence, '' AS review_eloquence_note,
         (a + 0.0 + w + e) / 4 AS review_score FROM parts""",
)



def judge_prompts(spark, sf_dir):
    """Judge messages of three kinds for every document."""
    text = F.col("text")
    return bindings.table(spark, sf_dir, "documents").select(
        "doc_id",
        judging.rubric_messages(fixed.DESIGN_RUBRIC, text)[1]["content"].alias("rubric"),
        judging.review_messages(text)[1]["content"].alias("review"),
        judging.hallucination_messages(F.col("source"), text)[1]["content"].alias("hallucination"),
    )


def _chars(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"


_LISTED = "\n".join(f"- {n}: {d}" for n, d in fixed.REVIEW_CRITERIA.items())
_SHAPE = ", ".join(f'"{n}": {{"score": <0..1>, "note": "<short>"}}' for n in fixed.REVIEW_CRITERIA)
_REVIEW_OPENING = fixed.REVIEW_HEAD + _LISTED + fixed.REVIEW_SHAPE_HEAD + "{" + _SHAPE + "}" + fixed.REVIEW_TAIL
SQL["judge_prompts"] = f"""
SELECT doc_id, {_chars(fixed.DESIGN_RUBRIC + fixed.RUBRIC_FORMAT)} || text AS rubric, {_chars(_REVIEW_OPENING)} || text AS review,
  {_chars(fixed.HALLUCINATION_HEAD)} || source || {_chars(fixed.HALLUCINATION_MIDDLE)} || text AS hallucination FROM documents"""


def _artifacts(spark, sf_dir) -> DataFrame:
    """A row per sample with something to judge: a root cause for bugs, else a text."""
    cause = F.concat(F.lit('{"root_cause": "'), F.col("payload.symptom"), F.lit('"}'))
    return bindings.samples(spark, sf_dir).select(
        F.lit("m").alias("model_slug"), "track", "sample_id", F.lit(0).alias("trial"), "payload",
        F.when(F.col("track") == "bug_localization", cause).otherwise(F.col("payload.requirement")).alias("parsed"),
    )


# What each judge is shown, by track.
_SHOWN = {
    "hallucination": f"{_chars(fixed.HALLUCINATION_HEAD)} || source || {_chars(fixed.HALLUCINATION_MIDDLE)} || requirement",
    "design": f"{_chars(fixed.DESIGN_RUBRIC + fixed.RUBRIC_FORMAT)} || requirement",
    "explanation": f"{_chars(fixed.EXPLANATION_RUBRIC + fixed.RUBRIC_FORMAT)} || 'BUGGY CODE:' || chr(10) || source || chr(10) || chr(10) || 'EXPLANATION:' || chr(10) || symptom",
    "test_case_design": f"{_chars(fixed.TEST_DESIGN_RUBRIC + fixed.RUBRIC_FORMAT)} || 'REQUIREMENT:' || chr(10) || requirement || chr(10) || chr(10) || 'SUITE:' || chr(10) || requirement",
    "review": f"{_chars(_REVIEW_OPENING)} || requirement",
}
_TRACKS_OF = {
    "hallucination": "track = 'unit_test_gen'", "design": "track = 'unit_test_gen'", "explanation": "track = 'bug_localization'",
    "test_case_design": "track = 'test_case_design'", "review": "track LIKE 'e2e%'",
}
_ASKED = " UNION ALL ".join(
    f"SELECT track, sample_id, '{judge}' AS judge, {text} AS content FROM v_samples WHERE {_TRACKS_OF[judge]}" for judge, text in _SHOWN.items()
)


def judge_messages(spark, sf_dir):
    """The user message of every judge of every sample."""
    asked = rejudge.judges_of(_artifacts(spark, sf_dir))
    messages = judging.judge_messages(F.col("judge"), F.col("payload"), F.col("parsed"))
    return asked.select("track", "sample_id", "judge", messages[1]["content"].alias("content"))


SQL["judge_messages"] = with_bindings("samples", f"WITH asked AS ({_ASKED}) SELECT * FROM asked")


def judged_samples(spark, sf_dir):
    """Columns of all five judges out of replies of which some came twice and some failed."""
    rows = _artifacts(spark, sf_dir)
    asked = rejudge.judge_requests(rows, "judge-1").select("request_key", F.length(F.col("messages")[1]["content"]).alias("n"))
    n, text = F.col("n"), lambda c: c.cast("string")
    given = F.concat(
        F.lit('{"score": '), text(n % 9 / 8), F.lit(', "rationale": "n'), text(n % 5), F.lit('", "hallucinated": '), text(n % 2 == 0),
        F.lit(', "readability": {"score": 0.5, "note": "r"}}'),
    )
    first = asked.select("request_key", F.lit('{"score": 0.0625}').alias("reply"), F.lit(1).alias("ingest_seq"))
    last = asked.select("request_key", F.when(n % 7 != 0, given).alias("reply"), F.lit(2).alias("ingest_seq"))
    judged = rejudge.with_judgements(rejudge.with_request_keys(rows, "judge-1"), last.unionByName(first))
    return judged.select(
        "track", "sample_id", "hallucinated", "design_judge", "design_note", "explanation_judge", "review_readability", "review_score",
        F.col("_design_passed").alias("passed"),
    )


SQL["judged_samples"] = with_bindings(
    "samples",
    f"""WITH asked AS ({_ASKED}), read AS (
          SELECT *, len(content) AS n, len(content) % 7 <> 0 AS ok, CASE WHEN ok THEN (n % 9) / 8.0::DOUBLE ELSE 0 END AS score,
            CASE WHEN ok THEN 'n' || CAST(n % 5 AS VARCHAR) ELSE '' END AS note FROM asked)
        SELECT track, sample_id, bool_or(ok AND n % 2 = 0) FILTER (judge = 'hallucination') AS hallucinated,
          max(score) FILTER (judge IN ('design', 'test_case_design')) AS design_judge, max(note) FILTER (judge IN ('design', 'test_case_design')) AS design_note,
          max(score) FILTER (judge = 'explanation') AS explanation_judge,
          max(CASE WHEN ok THEN 0.5::DOUBLE ELSE 0 END) FILTER (judge = 'review') AS review_readability,
          max(CASE WHEN ok THEN 0.125::DOUBLE ELSE 0 END) FILTER (judge = 'review') AS review_score,
          bool_or(score >= {fixed.DESIGN_PASS}) FILTER (judge = 'test_case_design') AS passed
        FROM read GROUP BY track, sample_id""",
)


def replayed_replies(spark, sf_dir):
    """Requests with their reply; unmatched and failed ones read as an empty object."""
    replies = bindings.replies(spark, sf_dir)
    key = F.sha2(F.concat_ws(":", F.lit("req"), F.col("doc_id").cast("string")), 256)
    answered = replies.filter(F.col("doc_id") % 3 != 0).select(
        key.alias("request_key"), F.when(F.col("doc_id") % 3 == 1, F.col("reply")).alias("reply")
    )
    fields = rejudge.read_replies(answered).withColumn("_found", F.lit(True))
    asked = replies.select("doc_id", key.alias("request_key"))
    return asked.join(fields, "request_key", "left").select(
        "doc_id",
        F.expr("if(_found, score, 0D)").alias("score"),
        F.expr("coalesce(flag, false)").alias("flag"),
    )


SQL["replayed_replies"] = with_bindings(
    "replies",
    """WITH given AS (SELECT *, valid AND doc_id % 3 = 1 AS r FROM v_replies)
       SELECT doc_id, CASE WHEN r THEN score ELSE 0.0::DOUBLE END AS score, r AND flag AS flag FROM given""",
)


def judges_of_rows(spark, sf_dir):
    """Rows per track and judge."""
    return rejudge.judges_of(bindings.scored(spark, sf_dir)).groupBy("track", "judge").agg(
        F.count(F.lit(1)).alias("n_rows")
    )


_PAIRS = ", ".join(f"('{t}', '{j}')" for t, j in fixed.JUDGES_BY_TRACK)
SQL["judges_of_rows"] = with_bindings(
    "scored",
    f"""SELECT track, judge, count(*) AS n_rows FROM v_scored JOIN (VALUES {_PAIRS}) AS j(track, judge) USING (track) GROUP BY 1, 2""",
)


def last_raw_outputs(spark, sf_dir):
    """Scored rows with the raw output that arrived last for their key."""
    scored = bindings.scored(spark, sf_dir).select(*fixed.KEY_COLUMNS, "tokens_out")
    responses = bindings.responses(spark, sf_dir)
    return rejudge.with_raw_outputs(scored, responses)


SQL["last_raw_outputs"] = with_bindings(
    "responses",
    f"""WITH latest AS (SELECT {_KEY}, arg_max_null(raw_output, ingest_seq) AS raw_output FROM v_responses WHERE trial IS NOT NULL GROUP BY ALL)
        SELECT {_KEY}, tokens_out, coalesce(raw_output, '') AS raw_output FROM v_scored LEFT JOIN latest USING ({_KEY})""",
)


def drop_stale(spark, sf_dir):
    """Scored rows without error columns and without judge values of other tracks."""
    part = F.col("trial")
    stale = bindings.scored(spark, sf_dir).select(
        *fixed.KEY_COLUMNS,
        "tokens_out",
        F.lit(0.5).alias("design_judge"),
        (part == 1).alias("hallucinated"),
        (part / 4).alias("review_score"),
        F.lit("402").alias("score_design_error"),
        F.lit(0.5).alias("review_flakiness"),
    )
    return rejudge.drop_stale(stale)


SQL["drop_stale"] = with_bindings(
    "scored",
    f"""SELECT {_KEY}, tokens_out, CASE WHEN track IN ('unit_test_gen', 'test_case_design') THEN 0.5::DOUBLE END AS design_judge,
          CASE WHEN track = 'unit_test_gen' THEN trial = 1 END AS hallucinated,
          CASE WHEN track LIKE 'e2e%' THEN trial / 4.0::DOUBLE END AS review_score FROM v_scored""",
)


def merge_fresh(spark, sf_dir):
    """Fresh values over older ones by key."""
    events = bindings.table(spark, sf_dir, "events")
    key = F.col("event_id")
    old = events.select("event_id", (key % 4 / 4).alias("design_judge"), "event_type")
    fresh = events.filter(F.col("event_type") != "view").select(
        "event_id",
        F.when(key % 5 != 0, key % 8 / 8).alias("design_judge"),
        (key % 2 == 0).alias("hallucinated"),
    )
    return rejudge.merge_fresh(old, fresh, ("design_judge", "hallucinated"), ("event_id",))


SQL["merge_fresh"] = """
SELECT event_id, event_type, CASE WHEN event_type = 'view' THEN (event_id % 4) / 4.0::DOUBLE WHEN event_id % 5 <> 0 THEN (event_id % 8) / 8.0::DOUBLE END AS design_judge,
  CASE WHEN event_type <> 'view' THEN event_id % 2 = 0 END AS hallucinated FROM events"""

for _fn in (
    runner_logs, unit_verdicts, unit_feedback, test_tallies, browser_verdicts, text_tails,
    gateway_scripts, transient_failures, usage_replies, localization_verdicts, judge_scores,
    hallucination_flags, review_scores, judge_prompts, judge_messages, judged_samples, replayed_replies, judges_of_rows,
    last_raw_outputs, drop_stale, merge_fresh,
):
    QUERIES[_fn.__name__] = _fn
