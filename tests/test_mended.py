"""Rules that held in earlier tests only by the way they were asked."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import schemas
from scorelake.dimensions import track_dimension
from scorelake.functions import execution
from scorelake.functions.localization import numbered_listing
from scorelake.operators import compare, planning, rejudge, validation
from scorelake.plans import scoring
from scorelake.sources import datasets, facts, registry, summaries
from tests.test_planning import TOML
from tests.test_scoring import _logs, _responses, _samples


def _raises(df, message):
    for ask in (lambda d: d.count(), lambda d: d.groupBy().agg(F.count(F.lit(1))).collect(), lambda d: d.select(F.lit(1)).collect()):
        with pytest.raises(Exception, match=message):
            ask(df)


def test_guards_hold_whatever_is_asked(spark):
    models = registry.models_from_toml(spark, TOML)
    _raises(planning.select_models(models, "a, nope"), "Unknown model slug")
    _raises(planning.select_tracks(track_dimension(spark), "nope"), "Unknown track")
    rows = scoring.base_rows(_responses(spark)).withColumn("sample_id", F.lit("nope"))
    _raises(scoring.with_samples(rows, _samples(spark)), "unknown sample")
    samples = spark.createDataFrame([("e2e_ui", "s")], "track string, sample_id string")
    _raises(planning.plan_tasks(planning.select_models(models, "nope"), samples), "Unknown model slug")
    assert planning.select_models(models, "b").count() == 1


def test_counts_equal_the_plan(spark):
    models = registry.models_from_toml(spark, TOML)
    samples = spark.createDataFrame(
        [(t, f"s{i:03d}") for t, n in (("e2e_ui", 50), ("e2e_repair", 3), ("other", 4)) for i in range(n)], "track string, sample_id string"
    )
    for trials, limit in ((2, None), (1, 2), (0, None)):
        pairs = planning.plan_tasks(models, samples, trials=trials, limit=limit)
        counts = planning.task_counts(models, samples, trials=trials, limit=limit)
        want = pairs.groupBy("model_slug", "track", "trial").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("sample_id").alias("d"))
        assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, want.collect()))
        assert planning.total_tasks(counts).first()[0] == pairs.count()


def test_summaries_are_read_by_name(spark, tmp_path):
    texts = {
        "first run": "model_slug,track,n_samples,n_trials,recall,composite,tier\nm,ALL,3,1,0.9,0.4,C\n",
        "2+2": "mood,composite,track,model_slug\r\nhappy,0.5,ALL,\"m, two\"\r\n",
        "empty": "model_slug,track,composite\n",
        "odd": "track,model_slug,composite,n_samples\nALL,m,not a number,x\n",
    }
    for name, text in texts.items():
        os.makedirs(tmp_path / "runs" / name)
        (tmp_path / "runs" / name / "summary.csv").write_text(text)
    rows = {r.run_id: r for r in summaries.read_all_summaries(spark, str(tmp_path / "runs")).collect()}
    assert set(rows) == {"first run", "2+2", "odd"}
    first, second, odd = (rows[n] for n in ("first run", "2+2", "odd"))
    assert (first.recall, first.composite, first.tier, first.multi_shot_pass_rate, first.n_samples) == (0.9, 0.4, "C", None, 3)
    assert (second.model_slug, second.composite, second.tier, second.recall) == ("m, two", 0.5, None, None)
    assert (odd.composite, odd.n_samples) == (None, None)
    assert second.run_mtime is not None
    one = summaries.read_summary(spark, str(tmp_path / "runs" / "2+2" / "summary.csv")).first()
    assert one.composite == 0.5
    assert summaries.read_all_summaries(spark, str(tmp_path / "none")).count() == 0


FILES = {
    "unit_test_gen/two words": {"source.py": "x = 1", "meta.json": '{"module_name": "m"}', "mutants/b.py": "B", "mutants/a.py": "A"},
    "bug_localization/b+b": {"buggy.py": "y", "meta.json": '{"module_name": "n", "fault_lines": [2], "symptom": "s"}', "test_hidden.py": "t"},
    "test_case_design/d": {"requirement.md": "r", "reference_classes.json": '{"equivalence_classes": ["e"], "boundary_values": [1]}', "meta.json": "{}"},
    "e2e_ui/100%": {"flow.md": "f", "meta.json": '{"success_assertion": "done"}'},
    "e2e_advanced/a": {"flow.md": "f", "meta.json": '{"expected_pattern": "network", "base_url": "http://x"}'},
    "e2e_repair/r": {"broken.spec.ts": "z", "error.txt": "e", "meta.json": "{}"},
}


def test_every_sample_shape_is_read_from_folders(spark, tmp_path):
    for folder, files in FILES.items():
        for name, text in files.items():
            path = tmp_path / "data" / folder / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    rows = {f"{r.track}/{r.sample_id}": r for r in datasets.read_samples(spark, str(tmp_path / "data")).collect()}
    assert set(rows) == set(FILES)
    payload = {k: r.payload for k, r in rows.items()}
    assert payload["unit_test_gen/two words"].mutants == ["A", "B"]
    assert payload["bug_localization/b+b"].fault_lines == [2] and payload["bug_localization/b+b"].test == "t"
    assert payload["test_case_design/d"].reference.equivalence_classes == ["e"]
    assert payload["e2e_ui/100%"].success == "done" and payload["e2e_ui/100%"].flow == "f"
    assert payload["e2e_advanced/a"].expected_pattern == "network" and payload["e2e_advanced/a"].base_url == "http://x"
    assert payload["e2e_repair/r"].broken_test == "z" and payload["e2e_repair/r"].error == "e"


def test_overflowing_log_is_a_bad_log(spark):
    logs = [('{"tests_total": 5000000000, "collection_ok": true}', ""), ('{"tests_total": 3, "tests_failing_on_correct": 0, "collection_ok": true}', "")]
    df = spark.createDataFrame([(f"##OUT##\n{b}", e, 2) for b, e in logs], "out string, err string, n int")
    df = execution.with_blob(df, "out", "##OUT##")
    got = df.select(*(c.alias(n) for n, c in execution.unit_verdict("out", "err", "n").items())).collect()
    assert [(r.exec_ok, r.passed, r.tests_total, r.mutants_surviving) for r in got] == [(False, False, 0, 2), (True, True, 3, 0)]
    assert "5000000000" in got[0].exec_error


def test_scoring_takes_a_marker_and_scorers(spark, rows):
    from scorelake import fixed_values as fixed

    logs = _logs(spark).withColumn("stdout", F.replace("stdout", F.lit(fixed.RESULT_MARKER), F.lit("@@")))
    replies = spark.createDataFrame([], "request_key string, reply string")

    def length(row):
        if row["track"] == "e2e_ui":
            raise RuntimeError("no browser")
        return {"n_raw": len(row["raw_output"])}

    kind = T.StructType([T.StructField("n_raw", T.IntegerType())])
    scorers = [scoring.captured("length", length, ["track", "raw_output"], kind), lambda df: df.withColumn("shouts", F.upper("sample_id"))]
    scored = scoring.score(_responses(spark), _samples(spark), logs, replies, "j", marker="@@", scorers=scorers)
    assert scored.columns == [*schemas.SCORED.fieldNames(), "n_raw", "length_error", "shouts"]
    got = {r["track"]: r for r in rows(scored)}
    assert got["unit_test_gen"]["exec_ok"] and got["unit_test_gen"]["passed"]
    assert got["e2e_ui"]["n_raw"] is None and got["e2e_ui"]["length_error"] == "RuntimeError: no browser"
    assert got["test_case_design"]["n_raw"] > 0 and got["test_case_design"]["shouts"] == "D"
    audit = {r.track: r.n_length_error for r in validation.error_audit(scored).collect()}
    assert audit["e2e_ui"] == 1 and audit["unit_test_gen"] == 0


def test_unknown_columns_are_kept_on_request(spark, tmp_path):
    path = str(tmp_path / "facts")
    spark.createDataFrame([("m", 7)], "model_slug string, mine long").write.json(path)
    assert facts.read_jsonl(spark, path, schemas.RESPONSES, open_columns=True).first().mine == 7
    assert "mine" not in facts.read_jsonl(spark, path, schemas.RESPONSES).columns


def test_lines_end_like_in_python(spark):
    texts = ["a\x0cb", "a\x0bb\x1cc\x1dd\x1ee", "a\x85b c d\n", "a\r\nb\rc", "\n", "a\n\n"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", numbered_listing(F.col("t")).alias("n")).collect():
        lines = texts[r.i].splitlines()
        assert r.n == "\n".join(f"{k:>3}  {line}" for k, line in enumerate(lines, 1))


def test_last_reply_and_fresh_nulls_win(spark):
    replies = spark.createDataFrame(
        [("k", '{"score": 0.9}', 1), ("k", '{"score": 0.25}', 2), ("f", '{"score": 1}', 1), ("f", None, 2)], "request_key string, reply string, ingest_seq int"
    )
    assert {r.request_key: r.score for r in rejudge.read_replies(replies).collect()} == {"k": 0.25, "f": 0.0}
    old = spark.createDataFrame([(1, 0.5), (2, 0.5)], "event_id int, design_judge double")
    fresh = spark.createDataFrame([(1, None)], "event_id int, design_judge double")
    merged = rejudge.merge_fresh(old, fresh, ("design_judge",), ("event_id",)).collect()
    assert {r.event_id: r.design_judge for r in merged} == {1: None, 2: 0.5}


def test_outdated_criteria_go(spark):
    df = spark.createDataFrame([("e2e_ui", 0.5, 0.5)], "track string, review_flakiness double, review_score double")
    assert rejudge.drop_stale(df).columns == ["track", "review_score"]


def test_report_heads_follow_their_run(spark):
    summary = spark.createDataFrame(
        [("r1", "ALL", "m", 0.5), ("r2", "ALL", "m", 0.7), ("r2", "ALL", "n", 0.9)], "run_id string, track string, model_slug string, composite double"
    )
    heads = registry.manifest(spark, {"run_id": "r1", "judge_model": "one"}).unionByName(registry.manifest(spark, {"run_id": "r2", "judge_model": "two"}))
    got = {(r.run_id, r.model_slug): (r.position, r.run.judge_model) for r in compare.report_tables(summary, heads).collect()}
    assert got == {("r1", "m"): (1, "one"), ("r2", "n"): (1, "two"), ("r2", "m"): (2, "two")}


def test_ranks_do_not_depend_on_ranges(spark):
    values = [(float(v % 37), 1) for v in range(400)] + [(float("inf"), 2), (-5.0, 3)]
    df = spark.createDataFrame(values, "x double, n long")
    found = []
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        for partitions in (1, 5, 17):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            found.append(sorted(map(tuple, validation.average_ranks(df, "x", "n").collect())))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert found[0] == found[1] == found[2] and len(found[0]) == 39


def test_text_queries_reach_every_branch(spark):
    """No flag or score of the catalog's texts is the same on all rows."""
    from scorelake.catalog import all_queries

    data = "/root/testdata/sf0.01"
    if not os.path.isdir(data):
        pytest.skip("no test data")
    table = all_queries()["text_job"](spark, data)
    shown = [c for c in table.columns if c not in ("doc_id", "expected_pattern")]
    kinds = table.agg(*(F.count_distinct(c).alias(c) for c in shown)).first().asDict()
    assert {c: n for c, n in kinds.items() if n < 2} == {}
    apart = table.agg(
        F.sum((F.col("uses_structure") & ~F.col("uses_page_object")).cast("int")).alias("helpers"),
        F.sum((F.col("has_code_smell") & ~F.col("uses_fragile_selector")).cast("int")).alias("smells"),
    ).first()
    assert apart.helpers > 0 and apart.smells > 0
