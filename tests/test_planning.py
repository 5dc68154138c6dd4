"""Selection, planning, resuming, attempts, prompts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from scorelake import schemas
from scorelake.dimensions import track_dimension
from scorelake.functions import prompting
from scorelake.operators import attempts, planning
from scorelake.sources.registry import models_from_toml

TOML = """
[[model]]
slug = "a"
id = "v/a"
provider = "openrouter"
input_cost_per_mtok = 2.0
output_cost_per_mtok = 4.0

[[model]]
slug = "b"
id = "v/b"
provider = "local"
label = "Bee"
skip_by_default = true
"""


@pytest.fixture
def models(spark):
    return models_from_toml(spark, TOML)


def slugs(df):
    return [r.slug for r in df.collect()]


def test_registry_defaults(models):
    assert {r.slug: r.label for r in models.collect()} == {"a": "a", "b": "Bee"}
    assert models.schema == schemas.MODELS or models.columns == schemas.MODELS.fieldNames()


def test_unknown_provider(spark):
    with pytest.raises(ValueError, match="provider"):
        models_from_toml(spark, '[[model]]\nslug = "x"\nid = "x"\nprovider = "other"\n')


def test_select_models(models):
    assert slugs(planning.select_models(models, "all")) == ["a"]
    assert slugs(planning.select_models(models, "*")) == ["a", "b"]
    assert slugs(planning.select_models(models, "b, a")) == ["b", "a"]
    with pytest.raises(Exception, match="Unknown model slug"):
        planning.select_models(models, "nope").collect()


def test_select_tracks(spark):
    tracks = track_dimension(spark)
    assert planning.select_tracks(tracks, "all").count() == 6
    assert [r.track for r in planning.select_tracks(tracks, "e2e_ui,unit_test_gen").collect()] == ["e2e_ui", "unit_test_gen"]
    with pytest.raises(Exception, match="Unknown track"):
        planning.select_tracks(tracks, "nope").collect()
    assert planning.track_names("e2e_ui") == ["e2e_ui"]
    with pytest.raises(KeyError):
        planning.track_names("nope")


def test_plan_and_resume(spark, models):
    samples = spark.createDataFrame(
        [(t, f"s{i:03d}") for t, n in (("e2e_ui", 500), ("e2e_repair", 3)) for i in range(n)],
        "track string, sample_id string",
    )
    everything = planning.plan_tasks(models, samples, trials=2)
    assert everything.count() == 2 * 503 * 2
    limited = planning.plan_tasks(models, samples, ["e2e_ui"], trials=1, limit=2)
    assert sorted((r.model_slug, r.sample_id) for r in limited.collect()) == [
        ("a", "s000"), ("a", "s001"), ("b", "s000"), ("b", "s001")
    ]
    assert planning.plan_tasks(models, samples, trials=0).count() == 0
    assert planning.without_done(limited, limited.filter("model_slug = 'a'")).count() == 2
    assert planning.without_done(limited, limited).count() == 0
    assert planning.total_tasks(planning.task_counts(models, samples, trials=2)).first().total_tasks == 2012


def test_cost(spark, models):
    usage = spark.createDataFrame([("a", 1_000_000, 1_000_000)], "model_slug string, tokens_in long, tokens_out long")
    assert planning.with_cost(usage, models).first().cost == 6.0


def test_word_count_and_hash(spark):
    df = spark.createDataFrame([("a b c",), ("  ",)], "t string")
    got = df.select(prompting.word_count(F.col("t")).alias("n"), prompting.prompt_hash(F.col("t")).alias("h")).collect()
    assert [r.n for r in got] == [3, 0]
    assert all(len(r.h) == 12 for r in got)


def test_attempts(spark, rows):
    data = [
        ("m", "t", "pass2", 0, 1, 10, 5, 1.0, 0.1, False, "", "one"),
        ("m", "t", "pass2", 0, 2, 10, 5, 1.0, 0.1, True, "", "two"),
        ("m", "t", "pass2", 0, 3, 10, 5, 1.0, 0.1, True, "", "three"),
        ("m", "t", "never", 0, 1, 1, 1, 0.5, 0.1, False, "", "x"),
        ("m", "t", "never", 0, 2, 1, 1, 0.5, 0.1, False, "", "y"),
        ("m", "t", "error", 0, 1, 1, 1, 0.5, 0.1, False, "", "kept"),
        ("m", "t", "error", 0, 2, 9, 9, 9.0, 9.0, False, "boom", "lost"),
    ]
    schema = (
        "model_slug string, track string, sample_id string, trial int, attempt int, tokens_in long, "
        "tokens_out long, latency_s double, cost double, passed boolean, error string, raw_output string"
    )
    df = spark.createDataFrame(data, schema)
    got = {r["sample_id"]: r for r in rows(attempts.roll_up(df, 3))}
    assert (got["pass2"]["attempts"], got["pass2"]["tokens_in"], got["pass2"]["raw_output"]) == (2, 20, "two")
    assert (got["never"]["attempts"], got["never"]["raw_output"]) == (2, "y")
    assert (got["error"]["attempts"], got["error"]["tokens_in"]) == (2, 1)
    assert (got["error"]["raw_output"], got["error"]["error"]) == ("kept", "boom")
    ready = df.withColumns({"messages": F.array(F.struct(F.lit("user").alias("role"), F.lit("q").alias("content"))), "feedback": F.lit("bad.")})
    due = attempts.next_requests(ready, 3).collect()
    assert {(r.sample_id, r.attempt) for r in due} == {("pass2", 2), ("never", 2), ("never", 3), ("error", 2)}
    assert due[0].messages[-1].content == "Your attempt did not pass. bad. Try again."
