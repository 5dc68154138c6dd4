"""Scoring costs per row: what the plan does not do for every row, and that the cheaper forms say the same."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake import schemas
from scorelake.functions import craft, detectors, judging, lexing, parsing
from scorelake.functions.localization import split_lines
from scorelake.plans import scoring

TEXTS = [
    "", " ", "a", "// x\ny", "a /* b */ c", "'// no' // yes", '"a\\"//" /*open', "`/*` /* x */ '", "/", "a / b // $1 \\", "é//😀\n`", "/**/",
    "\r\n", "a\r\nb\x85", "a\n\n", "\x0b\x1c", "a\r", "\u2028x", "\n\r",
    "```ts\nx\n```", " ```\na\n``` ```TypeScript\n b \n```", "```py\nopen", "\u3000x\xa0",
    "NTH-CHILD", "nth-ch\u0131ld(2)", "//tr[1]", "// tr[1]", 'XPath="', "goto('http://a')", "wa\u0131tForURL(`HTTPS://a`)", None,
]


def _texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")


def _logs(spark, stdout):
    rows = [("m", track, "s", 0, 0, False, stdout, "") for track in ("unit_test_gen", "e2e_ui")]
    return spark.createDataFrame(rows, "model_slug string, track string, sample_id string, trial int, exit_code int, timed_out boolean, stdout string, stderr string")


def _scored(spark):
    responses = spark.createDataFrame(
        [("m", t, "s", 0, "```ts\nawait page.goto('http://x/'); // tr[1]\n```") for t in ("unit_test_gen", "e2e_ui", "e2e_repair")],
        "model_slug string, track string, sample_id string, trial int, raw_output string",
    )
    for f in schemas.RESPONSES.fields:
        if f.name not in responses.columns:
            responses = responses.withColumn(f.name, F.lit(None).cast(f.dataType))
    payload = F.struct(*(F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.PAYLOAD.fields))
    samples = responses.select("track", "sample_id", payload.alias("payload"))
    stdout = fixed.RESULT_MARKER + '\n{"tests_total": 2, "tests_failing_on_correct": 0, "collection_ok": true}'
    replies = spark.createDataFrame([], "request_key string, reply string")
    return scoring.score(responses, samples, _logs(spark, stdout), replies, "judge")


def test_result_lines_are_parsed_before_the_join(spark):
    """Once per log of a unit test; parsing them behind the join costs every wide row."""
    scored = _scored(spark)
    got = {r.track: r for r in scored.collect()}
    assert got["unit_test_gen"].exec_ok and got["unit_test_gen"].passed and got["unit_test_gen"].tests_total == 2
    assert got["e2e_ui"].exec_ok is None and got["e2e_ui"].e2e_passed and got["e2e_repair"].e2e_ran is False
    plan = scored._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("from_json")]
    assert re.search(r"Join LeftOuter.*model_slug", above)


def test_payloads_are_settled_before_the_pattern_search(spark):
    """Layers that look for patterns do not carry payload and output."""
    plan = _scored(spark)._jdf.queryExecution().analyzed().toString().splitlines()
    layers = [line for line in plan if "AS _bare#" in line or "AS assertion_quality#" in line]
    assert layers and not any(re.search(r"\b(payload|raw_output|parsed)#", line) for line in layers)


def test_scanning_by_comments(spark):
    tokens = f"(?s){lexing._STRING}|{lexing._COMMENT}|[^\"'`/]++|."
    every = F.regexp_extract_all("t", F.lit(tokens), F.lit(0))
    slow = F.array_join(F.transform(every, lambda t: F.when(t.rlike("^/[/*]"), F.lit(" ")).otherwise(t)), "")
    assert _texts(spark).where(~lexing.strip_comments(F.col("t")).eqNullSafe(slow)).count() == 0
    plan = _texts(spark).select(lexing.strip_comments(F.col("t")))._jdf.queryExecution().optimizedPlan().toString()
    assert "transform" not in plan


def test_lines_and_blocks(spark):
    got = _texts(spark).select("t", split_lines(F.col("t")).alias("lines"), parsing.code_block(F.col("t")).alias("code")).collect()
    blocks = {TEXTS[19]: "x", TEXTS[20]: "a", TEXTS[21]: "open"}
    for r in got:
        assert r.lines == (None if r.t is None else r.t.splitlines())
        assert r.code == (None if r.t is None else blocks.get(r.t, r.t.strip()))


def test_guards_of_patterns_without_case(spark):
    text = F.col("t")

    def hit(pattern):
        return F.regexp_like(text, F.lit("(?U)" + pattern))

    brittle, count = hit(fixed.BRITTLE_SELECTOR), F.regexp_count(text, F.lit("(?U)" + fixed.BRITTLE_SELECTOR))
    same = detectors.fragile_selector(text).eqNullSafe(brittle) & craft.hardcoded_url(text).eqNullSafe(hit(fixed.HARDCODED_URL))
    same = same & craft.locator_counts(text)["n_brittle"].eqNullSafe(count)
    assert _texts(spark).where(~same).count() == 0
    assert _texts(spark).where(brittle).count() == 4
    assert _texts(spark).where(craft.hardcoded_url(text)).count() == 2


def test_request_keys_of_constant_prompts(spark):
    payload = F.struct(F.col("t").alias("source"), F.reverse("t").alias("requirement"))
    for judge in judging._MESSAGES:
        made = judging.judge_request_key(F.lit("j"), F.lit(judge), payload, F.col("t"))
        slow = judging.request_key(F.lit("j"), judging.judge_messages(F.lit(judge), payload, F.col("t")))
        assert _texts(spark).where(~made.eqNullSafe(slow)).count() == 0
