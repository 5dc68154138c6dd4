"""What grows with the tables stays off the driver, off one task and off the disk."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake import schemas
from scorelake.operators import planning, rejudge
from scorelake.sources import datasets, facts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_folders_are_listed_in_tasks(spark, tmp_path):
    texts = {"a.md": "one\n", "b c%20.md": " two é", "empty.md": "", ".hidden.md": "x", "_left.md": "x", "note.txt": "x", "deep/c.md": "three"}
    for name, text in texts.items():
        (tmp_path / "p" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "p" / name).write_text(text)
    prompts = datasets.read_prompts(spark, str(tmp_path / "p"))
    assert [(r.track, r.text) for r in prompts.collect()] == [("a", "one"), ("b c%20", "two é")]
    every = datasets.read_texts(spark, str(tmp_path / "p"))
    assert {r.path.split("/p/")[1]: r.text for r in every.collect()} == {n: texts[n] for n in ("a.md", "b c%20.md", "note.txt", "deep/c.md")}
    # The driver knows the files of the listing only.
    for df in (prompts, every):
        assert not [f for f in df.inputFiles() if f.endswith((".md", ".txt"))]


def test_requests_are_counted_without_sorting_prompts(spark):
    payload = schemas.PAYLOAD.simpleString()
    data = [("m", t, str(i), 0, parsed) for i, (t, parsed) in enumerate([
        ("e2e_ui", "x"), ("e2e_repair", "x"), ("unit_test_gen", "x"), ("unit_test_gen", "y"), ("unit_test_gen", None), ("e2e_ui", None), ("test_case_design", None),
        ("bug_localization", '{"root_cause": "c", "line": 1}'), ("bug_localization", '{"root_cause": "c", "line": 2}'),
    ])]
    rows = spark.createDataFrame(data, "model_slug string, track string, sample_id string, trial int, parsed string").withColumn("payload", F.lit(None).cast(payload))
    asked = rejudge.judge_requests(rows, "j")
    assert "SortAggregate" not in _plan(asked)
    found = {r.request_key: r for r in asked.collect()}
    assert len(found) == asked.count()
    # x is reviewed twice; design sees x and y, as does the other judge of unit tests; one cause; no artifact: one per system message.
    assert sorted(r.n_rows for r in found.values()) == [1, 1, 1, 1, 1, 2, 2, 3]
    keyed = rejudge.with_request_keys(rows, "j").selectExpr("explode(array(_main_key, _side_key)) AS k").where("k NOT LIKE 'none:%'")
    assert {r.k for r in keyed.collect()} == set(found)


def test_plan_is_dealt_by_samples(spark):
    n = 4 * planning.TASK_SAMPLES
    samples = spark.range(n, numPartitions=1).select(F.lit("e2e_ui").alias("track"), F.concat(F.lit("s"), "id").alias("sample_id"))
    models = spark.range(2).select(F.concat(F.lit("m"), "id").alias("slug"))
    sizes = planning.plan_tasks(models, samples, trials=2).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 4 * n and max(r["count"] for r in sizes) <= n * 1.2


def test_lines_are_packed(spark, tmp_path):
    rows = spark.range(5000, numPartitions=1).select(
        *(F.lit("m").alias("model_slug") if f.name == "model_slug" else F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.RESPONSES.fields)
    )
    facts.append_jsonl(rows, str(tmp_path / "r"))
    facts.write_sparse(rows, str(tmp_path / "s"))
    for name, each in (("r", 200), ("s", 20)):
        assert sum(f.stat().st_size for f in (tmp_path / name).glob("part-*")) < 5000 * each / 10
        assert facts.read_jsonl(spark, str(tmp_path / name), schemas.RESPONSES).where("model_slug = 'm'").count() == 5000
