"""Comparison, sources, label checks and incremental runs."""

from __future__ import annotations

import json
import math
import random

import pytest
from pyspark.sql import functions as F

from scorelake import schemas
from scorelake.operators import compare, validation
from scorelake.operators.metrics import METRICS
from scorelake.operators.summary import summarize
from scorelake.sources import datasets, facts, golden, registry, summaries
from scorelake.streaming import incremental

SUMMARY = "run_id string, run_mtime timestamp, model_slug string, track string, composite double, tier string"


def _times(df):
    return df.withColumn("run_mtime", F.col("run_mtime").cast("timestamp"))


def test_latest_per_model(spark):
    data = [("old", "2024-01-01", "a", "ALL", 0.5, "C"), ("old", "2024-01-01", "a", "gone", 0.1, "C"),
            ("new", "2024-01-02", "a", "ALL", 0.9, "A"), ("new", "2024-01-02", "b", "ALL", 0.7, "B"),
            ("tie", "2024-01-02", "b", "ALL", 0.6, "B")]
    df = _times(spark.createDataFrame(data, SUMMARY.replace("timestamp", "string")))
    got = {(r.model_slug, r.track): r.composite for r in compare.latest_per_model(df).collect()}
    assert got == {("a", "ALL"): 0.9, ("b", "ALL"): 0.6}


@pytest.fixture
def summary(spark):
    data = [("m1", "ALL", 0.9, "A", 0.5), ("m2", "ALL", None, "n/a", 0.0), ("m3", "ALL", 0.95, "A", 0.05),
            ("m1", "unit_test_gen", 0.8, "A", 0.5), ("m1", "e2e_ui", 1.0, "A", 0.5), ("m3", "e2e_ui", 0.4, "C", 0.1)]
    return spark.createDataFrame(data, "model_slug string, track string, composite double, tier string, cost_per_run double")


def test_leaderboard_puts_gaps_last(summary):
    with_std = summary.withColumn("composite_std", F.lit(None).cast("double"))
    assert [(r.position, r.model_slug) for r in compare.leaderboard(with_std).collect()] == [(1, "m3"), (2, "m1"), (3, "m2")]


def test_category_and_grid(summary):
    got = compare.category_composites(summary).collect()
    assert [(r.model_slug, r.component, r.system) for r in got] == [("m3", None, 0.4), ("m1", 0.8, 1.0), ("m2", None, None)]
    grid = {r.model_slug: r.e2e_ui for r in compare.track_grid(summary).collect()}
    assert grid == {"m1": 1.0, "m3": 0.4}
    with pytest.raises(Exception, match="more than one"):
        compare.track_grid(summary.union(summary)).collect()


def test_cost_range_skips_free_models(summary):
    row = compare.cost_quality_range(summary).first()
    assert math.isclose(row.log_cost_min, math.log10(0.05)) and math.isclose(row.log_cost_max, math.log10(0.5))


def test_unknown_metric_gives_no_rows(summary):
    assert compare.metric_by_model(summary, "nope").count() == 0
    assert compare.overall_rows(summary.limit(0)).count() == 0


def test_run_difference(summary):
    after = summary.filter("model_slug <> 'm2'").withColumn("composite", F.col("composite") + 0.5)
    got = {(r.model_slug, r.track): r.composite_change for r in compare.run_difference(summary, after).collect()}
    assert got[("m1", "e2e_ui")] == 0.5 and got[("m2", "ALL")] is None


# --- Sources --------------------------------------------------------------------


def test_jsonl_round_trip(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    assert facts.read_jsonl(spark, path, schemas.RESPONSES).count() == 0
    row = {"model_slug": "m", "track": "t", "sample_id": "007", "trial": 0, "cost": math.nan, "raw_output": "a\nb"}
    df = spark.createDataFrame([tuple(row.get(n) for n in schemas.RESPONSES.fieldNames())], schemas.RESPONSES)
    facts.append_jsonl(df, path)
    facts.append_jsonl(df, path)
    (tmp_path / "r.jsonl" / "bad.json").write_text("{not json\n")
    back = facts.read_jsonl(spark, path, schemas.RESPONSES)
    good = back.filter(F.col(facts.CORRUPT).isNull())
    assert [(r.sample_id, r.cost, r.raw_output) for r in good.collect()] == [("007", None, "a\nb")] * 2
    assert back.cache().filter(F.col(facts.CORRUPT).isNotNull()).count() == 1
    sparse = str(tmp_path / "sparse")
    facts.write_sparse(df, sparse)
    line = spark.read.text(sparse).first().value
    assert set(json.loads(line)) == {"model_slug", "track", "sample_id", "trial", "raw_output"}
    with pytest.raises(Exception, match="exist"):
        facts.write_sparse(df, sparse)


def test_dataset_folder(spark, tmp_path):
    files = {
        "unit_test_gen/fizz/meta.json": '{"module_name": "fizz"}',
        "unit_test_gen/fizz/source.py": "def f(): pass\n",
        "unit_test_gen/fizz/mutants/m1.py": "two",
        "unit_test_gen/fizz/mutants/m0.py": "one",
        "bug_localization/med/meta.json": '{"module_name": "med", "fault_lines": [14], "symptom": "s"}',
        "bug_localization/med/buggy.py": "bug",
        "test_case_design/pw/requirement.md": "req",
        "test_case_design/pw/reference_classes.json": '{"equivalence_classes": ["a"], "boundary_values": [7]}',
        "e2e_ui/login/meta.json": '{"success_assertion": "ok"}',
        "e2e_ui/login/flow.md": "flow",
        "e2e_repair/fix/meta.json": '{"base_url": "http://h", "expected_pattern": "structure"}',
        "e2e_repair/fix/broken.spec.ts": "broken",
        "e2e_repair/fix/error.txt": "err",
    }
    for name, text in files.items():
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(text)
    got = {r.sample_id: r for r in datasets.read_samples(spark, str(tmp_path)).collect()}
    assert set(got) == {"fizz", "med", "pw", "login", "fix"}
    assert got["fizz"].payload.mutants == ["one", "two"] and got["fizz"].language == "python"
    assert got["med"].payload.fault_lines == [14] and got["med"].payload.test is None
    assert got["pw"].payload.reference.boundary_values == [7]
    assert got["login"].payload.base_url == "http://localhost:8080" and got["login"].payload.expected_pattern is None
    assert got["fix"].payload.expected_pattern == "structure" and got["fix"].payload.base_url == "http://h"


def test_prompts_and_manifest(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "e2e_ui.md").write_text("  Do it.\n")
    prompts = datasets.read_prompts(spark, str(tmp_path / "p")).collect()
    assert [(r.track, r.text, len(r.prompt_hash)) for r in prompts] == [("e2e_ui", "Do it.", 12)]
    models = registry.manifest_rows([{"slug": "a", "id": "v/a", "provider": "local"}])
    row = registry.manifest(spark, {"run_id": "r", "models": models, "tracks": ["e2e_ui"],
                                    "prompt_hashes": {"e2e_ui": "abc"}, "shots": 1, "trials": 2})
    registry.write_manifest(row, str(tmp_path / "m"))
    back = registry.read_manifest(spark, str(tmp_path / "m")).first()
    assert back.models[0].slug == "a" and back.prompt_hashes == {"e2e_ui": "abc"}


def test_summary_csv(spark, tmp_path):
    path = str(tmp_path / "runs/r1/summary.csv")
    assert summaries.read_summary(spark, path).count() == 0
    assert summaries.read_all_summaries(spark, str(tmp_path / "runs")).count() == 0
    one = spark.createDataFrame([("m", "ALL", 1, 1, *[None] * len(METRICS), None, "n/a")], schemas.summary_schema(METRICS))
    summaries.write_summary(one, path)
    back = summaries.read_all_summaries(spark, str(tmp_path / "runs")).first()
    assert (back.run_id, back.model_slug, back.composite, back.tier) == ("r1", "m", None, "n/a")


SHEET = """# Golden labeling

## Item 1 — expected technique: `api`
*Success condition:* x

```ts
const a = 1;
```

- technique_present:  yes
- craft (1-5):  3
- notes: fine

---

## Item 2 — expected technique: `polling`

- technique_present:
- craft (1-5):
- notes:
"""


def test_worksheet(spark, tmp_path):
    (tmp_path / "sheet.md").write_text(SHEET)
    got = golden.read_worksheets(spark, str(tmp_path / "sheet.md")).orderBy("item").collect()
    assert tuple(got[0]) == (1, "api", "yes", 3, "fine")
    assert tuple(got[1]) == (2, "polling", None, None, None)
    (tmp_path / "key.json").write_text('[{"item": 1, "auto_pattern_used": true},\n {"item": 2}]')
    assert golden.read_key(spark, str(tmp_path / "key.json")).count() == 2


# --- Label checks ---------------------------------------------------------------

# Ten labelled outputs: item, label, craft, judge score, detector verdict.
# The published labels, judge scores and verdicts of ten items.
GOLDEN = [
    (1, "yes", 3, 0.82, True), (2, "yes", 4, 0.72, True), (3, "yes", 4, 0.94, False), (4, "partial", 2, 0.80, False),
    (5, "yes", 4, 0.85, True), (6, "yes", 4, 0.93, True), (7, "partial", 3, 0.90, False), (8, "partial", 5, 0.90, False),
    (9, "yes", 3, 0.73, False), (10, "yes", 4, 0.92, True),
]


def test_golden_agreement_and_correlation(spark):
    df = spark.createDataFrame(GOLDEN, "item int, technique_present string, craft int, judge double, auto boolean")
    rho = validation.rank_correlation(df, "craft", "judge").first()
    assert rho.n_items == 10 and math.isclose(rho.rank_correlation, 0.447175, abs_tol=1e-6)
    strict = df.withColumns({"human": F.col("technique_present") == "yes"})
    loose = df.withColumns({"human": F.col("technique_present") != "no"})
    assert validation.agreement(strict, "human", "auto").first().agreement == 0.8
    assert validation.agreement(loose, "human", "auto").first().agreement == 0.5


def test_average_ranks_over_many_buckets(spark):
    pick = random.Random(5)
    values = [round(pick.gauss(0, 1), 2) for _ in range(5000)] + [0.5] * 2500
    counts = spark.createDataFrame([(v,) for v in values], "v double").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = {r.v: r.v_rank for r in validation.average_ranks(counts, "v", "n").collect()}
    ordered = sorted(values)
    first = {}
    for i, v in enumerate(ordered):
        first.setdefault(v, i)
    for v in set(values):
        assert got[v] == first[v] + (values.count(v) + 1) / 2


def test_leak_scan_equals_brute_force(spark):
    pick = random.Random(11)
    words = ["Alpha", "beta", "gamma-ray", "déjà", "x", "route(", "page object", "fixture", "AB"]
    texts = [" ".join(pick.choices(words, k=pick.randint(0, 30))) for _ in range(200)]
    terms = [" ".join(pick.choices(words, k=pick.randint(1, 6))) for _ in range(60)] + ["ture", "a ga", "T", ""]
    prompts = spark.createDataFrame(list(enumerate(texts)), "prompt_id int, text string")
    found = validation.leak_scan(prompts, spark.createDataFrame(list(enumerate(terms)), "term_id int, term string"))
    got = sorted((r.prompt_id, r.term_id) for r in found.collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, w in enumerate(terms) if w and w.lower() in t.lower())
    assert validation.leak_scan(prompts, spark.createDataFrame([], "term_id int, term string")).count() == 0


# --- Incremental runs -----------------------------------------------------------


def _arrivals(spark, first, last):
    data = [(f"m{i % 3}", ("unit_test_gen", "e2e_ui")[i % 2], f"s{i % 40}", i % 2, i % 5 != 0, float(i % 7), i) for i in range(first, last)]
    return spark.createDataFrame(
        data, "model_slug string, track string, sample_id string, trial int, passed boolean, coverage_pct double, seq long"
    )


def test_incremental_equals_batch(spark, rows, tmp_path):
    inbox, tables = str(tmp_path / "inbox"), incremental.Tables(str(tmp_path / "tables"))
    scorer = lambda df: df.drop("seq")
    everything = _arrivals(spark, 0, 300)
    for first, last in ((0, 100), (100, 150), (150, 300)):
        _arrivals(spark, first, last).write.mode("append").json(inbox)
        incremental.follow(spark, inbox, everything.schema, tables, scorer, "seq")
    incremental.follow(spark, inbox, everything.schema, tables, scorer, "seq")  # nothing new
    batch = scorer(incremental.first_arrivals(everything, "seq"))
    final = incremental.scored_so_far(spark, tables).drop("batch_id")
    assert final.exceptAll(batch.select(final.columns)).count() == 0 and final.count() == batch.count()
    assert rows(incremental.running_summary(spark, tables, batch.columns)) == rows(summarize(batch))


def test_repeated_batch_replaces_itself(spark, tmp_path):
    tables = incremental.Tables(str(tmp_path / "tables"))
    run = incremental.score_batch(tables, lambda df: df.drop("seq"), "seq")
    run(_arrivals(spark, 0, 50), 0)
    run(_arrivals(spark, 50, 90), 1)
    before = incremental.scored_so_far(spark, tables).count()
    run(_arrivals(spark, 50, 90), 1)
    assert incremental.scored_so_far(spark, tables).count() == before


def test_unique_stream_drops_repeats(spark, tmp_path):
    inbox, out = str(tmp_path / "inbox"), str(tmp_path / "out")
    df = _arrivals(spark, 0, 60)
    df.union(df).write.json(inbox)
    stream = incremental.unique_stream(spark.readStream.schema(df.schema).json(inbox))
    query = stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(out, "parquet")
    query.awaitTermination()
    keys = df.select("model_slug", "track", "sample_id", "trial").distinct().count()
    assert spark.read.parquet(out).count() == keys


def test_rescore_writes_beside(spark, tmp_path):
    path = str(tmp_path / "again")
    incremental.rescore(_arrivals(spark, 0, 50), lambda df: df.drop("seq"), "seq", path)
    assert spark.read.parquet(path).count() > 0
    with pytest.raises(Exception, match="exist"):
        incremental.rescore(_arrivals(spark, 0, 50), lambda df: df.drop("seq"), "seq", path)
