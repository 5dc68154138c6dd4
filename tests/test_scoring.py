"""Localization, execution logs, judge replies, and the whole scoring flow."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake import schemas
from scorelake.functions import execution, judging
from scorelake.functions.localization import numbered_listing
from scorelake.operators import localize, rejudge
from scorelake.operators.summary import summarize
from scorelake.plans import scoring

SPANS = [
    ({"line": 23}, (23, 23)),
    ({"start_line": 19, "end_line": 26}, (19, 26)),
    ({"start_line": 31, "end_line": 17}, (17, 31)),
    ({"start_line": "22"}, (22, 22)),
    ({"end_line": 4, "line": 1}, (4, 4)),
    ({"line": True}, (-1, -1)),
    ({"line": 23.0}, (-1, -1)),
    ({"line": " 7 "}, (7, 7)),
    ({"line": "x"}, (-1, -1)),
    ({"line": -3}, (-3, -3)),
    ({}, (-1, -1)),
]


def test_spans(spark):
    df = spark.createDataFrame([(i, json.dumps(r)) for i, (r, _) in enumerate(SPANS)], "i int, parsed string")
    hits = localize.with_hits(localize.with_span(df), F.array(F.lit(23)))
    got = {r.i: r for r in hits.collect()}
    assert [(got[i].predicted_line, got[i].predicted_end_line) for i in range(len(SPANS))] == [s for _, s in SPANS]
    assert got[0].localized and got[1].localized and not got[3].localized
    assert got[3].localized_within_1 and not got[4].localized_within_1
    none_known = localize.with_hits(localize.with_span(df), F.array().cast("array<int>")).first()
    assert none_known.localized is False


PATCHES = [
    ({"line": 2, "proposed_fix": "done()"}, "a\n    done()\nc\n"),
    ({"line": 2, "proposed_fix": "  done()"}, "a\n  done()\nc\n"),
    ({"start_line": 2, "end_line": 3, "proposed_fix": "x\ny"}, "a\nx\ny\n"),
    ({"line": 2, "proposed_fix": ""}, "a\n    \nc\n"),
    ({"line": 14, "proposed_fix": "x"}, None),
    ({"line": 2, "proposed_fix": 5}, None),
    ({"line": 2}, None),
]


@pytest.mark.parametrize("reply,expected", PATCHES)
def test_patches(spark, reply, expected):
    df = spark.createDataFrame([(json.dumps(reply),)], "parsed string").withColumn(
        "payload",
        F.struct(F.lit("a\n    b\nc\n").alias("source"), F.lit("t").alias("test"), F.lit("m").alias("module_name")),
    )
    assert localize.with_patch(localize.with_span(df), "parsed").first().patched == expected


def test_numbered_listing(spark):
    text = "\n".join(str(i) for i in range(1200))
    df = spark.createDataFrame([(text,)], "t string")
    lines = df.select(numbered_listing(F.col("t")).alias("l")).first().l.split("\n")
    assert lines[0] == "  1  0" and lines[1199] == "1200  1199"


def test_tally_quirk(spark):
    df = spark.createDataFrame([("3 passed, 2 errors in 1s",)], "t string")
    plain = df.select(execution.test_tally(F.col("t"))["n_total"].alias("n")).first().n
    doubled = df.select(execution.test_tally(F.col("t"), True)["n_total"].alias("n")).first().n
    assert (plain, doubled) == (5, 7)


def test_transient(spark):
    df = spark.createDataFrame(
        [(429, ""), (503, ""), (400, ""), (None, "ConnectError: x"), (None, "ValueError: x")], "s int, e string"
    )
    got = df.select(execution.is_transient(F.col("s"), F.col("e")).alias("t")).collect()
    assert [r.t for r in got] == [True, True, False, True, False]


SCORES = [
    ('{"score": 0.375, "rationale": "fair"}', 0.375, "fair"),
    ('{"score": 7}', 1.0, ""),
    ('{"score": -1}', 0.0, ""),
    ('{"score": true}', 1.0, ""),
    ('{"score": "0.9"}', 0.0, ""),
    ('{"score": null, "rationale": null}', 0.0, "None"),
    ('{"score": {"nan": null}}', None, ""),
    ("{}", 0.0, ""),
]


def test_rubric_replies(spark):
    df = spark.createDataFrame([(i, r) for i, (r, _, _) in enumerate(SCORES)], "i int, j string")
    got = {r.i: (r.score, r.note) for r in judging.with_rubric_reply(df, "j").collect()}
    assert [got[i] for i in range(len(SCORES))] == [(s, n) for _, s, n in SCORES]


def test_truthiness(spark):
    cases = [("true", True), ("false", False), ('"false"', True), ('""', False), ("0", False), ("2", True),
             ("null", False), ("[]", False), ("[0]", True), ("{}", False)]
    df = spark.createDataFrame([(i, f'{{"hallucinated": {v}}}') for i, (v, _) in enumerate(cases)], "i int, j string")
    got = {r.i: r.flag for r in judging.with_hallucination_reply(df, "j").collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]


def test_request_keys(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",)], "t string")
    messages = judging.rubric_messages("r", F.col("t"))
    keyed = df.select(messages.alias("messages")).withColumn("request_key", judging.request_key(F.lit("j"), F.col("messages")))
    found = rejudge.distinct_requests(keyed).collect()
    assert sorted(r.n_rows for r in found) == [1, 2]
    assert all(len(r.request_key) == 64 for r in found)


def _samples(spark):
    empty = {f.name: None for f in schemas.PAYLOAD.fields}
    data = [
        ("unit_test_gen", "u", "python", {**empty, "source": "def f(): pass", "module_name": "m", "mutants": ["x", "y"]}),
        ("bug_localization", "b", "python", {**empty, "source": "a\nb\nc", "module_name": "m", "fault_lines": [2], "test": "t"}),
        ("test_case_design", "d", "none", {**empty, "requirement": "req"}),
        ("e2e_ui", "e", "typescript", {**empty, "flow": "f", "base_url": "http://x"}),
        ("e2e_advanced", "a", "typescript", {**empty, "flow": "f", "expected_pattern": "network"}),
    ]
    return spark.createDataFrame(data, schemas.SAMPLES)


def _responses(spark):
    outputs = {
        ("unit_test_gen", "u"): "```python\nassert True\n```",
        ("bug_localization", "b"): '```json\n{"line": 2, "root_cause": "why", "proposed_fix": "B"}\n```',
        ("test_case_design", "d"): '{"test_cases": []}',
        ("e2e_ui", "e"): "```ts\nawait page.getByRole('button').click();\n```",
        ("e2e_advanced", "a"): "```ts\nawait page.route('x', r => r.abort());\n```",
    }
    data = [("m", "local", t, s, 0, 0, "h", 1, 2, 0.5, 0.1, "", raw) for (t, s), raw in outputs.items()]
    return spark.createDataFrame(data, schemas.RESPONSES)


def _logs(spark):
    blob = '{"tests_total": 3, "tests_failing_on_correct": 0, "collection_ok": true, "coverage_pct": 80, "mutants_total": 2, "mutants_killed": 1}'
    data = [
        ("m", "unit_test_gen", "u", 0, 0, f"x\n{fixed.RESULT_MARKER}\n{blob}\n", "", False, 1.0),
        ("m", "bug_localization", "b", 0, 0, "", "", False, 1.0),
        ("m", "e2e_ui", "e", 0, 1, "", "boom", False, 1.0),
        ("m", "e2e_advanced", "a", 0, 0, "", "", True, 1.0),
    ]
    return spark.createDataFrame(data, schemas.EXEC_RESULTS)


def _replies(spark, rows):
    requests = rejudge.judge_requests(rows, "j")
    return requests.select("request_key", F.lit('{"score": 0.625, "rationale": "ok", "hallucinated": false, "readability": {"score": 1.0, "note": "n"}}').alias("reply"))


def _parsed(spark):
    from scorelake.operators.text_features import parse_output

    return parse_output(scoring.with_samples(scoring.base_rows(_responses(spark)), _samples(spark)))


def test_whole_flow(spark, rows):
    replies = _replies(spark, _parsed(spark))
    assert replies.count() == 6  # one per judge of each row
    scored = scoring.score(_responses(spark), _samples(spark), _logs(spark), replies, "j")
    assert scored.columns == schemas.SCORED.fieldNames()
    got = {r["track"]: r for r in rows(scored)}
    unit, bug, design = got["unit_test_gen"], got["bug_localization"], got["test_case_design"]
    assert unit["attempts"] == 1  # a zero becomes one
    assert unit["passed"] and unit["mutants_surviving"] == 1 and unit["static_parses"] is True
    assert unit["design_judge"] == 0.625 and unit["hallucinated"] is False
    assert bug["localized"] and bug["repair_passed"] and bug["passed"]
    assert bug["explanation_judge"] == 0.625 and bug["design_judge"] is None
    assert design["passed"] is True and design["design_note"] == "ok"
    ui, advanced = got["e2e_ui"], got["e2e_advanced"]
    assert ui["e2e_ran"] and not ui["passed"] and ui["selectors_robust"] and ui["uses_network"] is None
    assert ui["review_score"] == 0.25
    assert not advanced["e2e_ran"] and advanced["pattern_used"] == 1.0 and advanced["selectors_robust"] is None
    assert summarize(scored).filter("track = 'ALL'").first().n_samples == 5


def test_unknown_sample_is_an_error(spark):
    rows = scoring.base_rows(_responses(spark)).withColumn("sample_id", F.lit("nope"))
    with pytest.raises(Exception, match="unknown sample"):
        scoring.with_samples(rows, _samples(spark)).collect()


def test_rejudge_refreshes_only_judges(spark, rows):
    responses = _responses(spark).withColumn("ingest_seq", F.lit(1))
    replies = _replies(spark, _parsed(spark))
    stale = scoring.base_rows(responses).drop("raw_output").withColumns(
        {
            "passed": F.col("track") != "test_case_design",
            "recall_kept": F.lit(0.5),
            "design_judge": F.lit(0.1),
            "score_design_error": F.lit("402"),
        }
    )
    fresh = scoring.refresh_judgements(stale, responses, _samples(spark), replies, "j")
    assert "score_design_error" not in fresh.columns
    got = {r["track"]: r for r in rows(fresh)}
    assert got["unit_test_gen"]["design_judge"] == 0.625 and got["unit_test_gen"]["recall_kept"] == 0.5
    assert got["e2e_ui"]["design_judge"] is None
    assert got["test_case_design"]["passed"] is True
