"""Declared schemas of every table the library reads or writes.

Facts are never schema-inferred: a declared type keeps sample ids strings, keeps
sparse booleans boolean, and lets the JSON/CSV readers skip a scan of the data.
"""

from __future__ import annotations

from pyspark.sql import types as T

from scorelake import fixed_values as fixed


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


S, I, L, D, B = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType()

MESSAGE = _struct(("role", S), ("content", S))
MESSAGES = T.ArrayType(MESSAGE)

KEY = (("model_slug", S), ("track", S), ("sample_id", S), ("trial", I))

RESPONSES = _struct(
    ("model_slug", S),
    ("provider", S),
    ("track", S),
    ("sample_id", S),
    ("trial", I),
    ("attempts", I),
    ("prompt_hash", S),
    ("tokens_in", L),
    ("tokens_out", L),
    ("latency_s", D),
    ("cost", D),
    ("error", S),
    ("raw_output", S),
)

PATTERN_FLAGS = tuple(
    f"uses_{name}" for name in ("structure", "page_object", *fixed.PATTERN_TECHNIQUES[1:])
)

SCORED_BASE = (
    ("model_slug", S),
    ("provider", S),
    ("track", S),
    ("sample_id", S),
    ("trial", I),
    ("attempts", I),
    ("tokens_in", L),
    ("tokens_out", L),
    ("latency_s", D),
    ("cost", D),
)

# The wide, sparse scored row: every column any scorer can emit.
SCORED = _struct(
    *SCORED_BASE,
    ("exec_ok", B),
    ("tests_total", I),
    ("tests_failing_on_correct", I),
    ("mutants_total", I),
    ("mutants_killed", I),
    ("mutants_surviving", I),
    ("coverage_pct", D),
    ("runs_and_valid", B),
    ("passed", B),
    ("exec_error", S),
    ("predicted_line", L),
    ("predicted_end_line", L),
    ("localized", B),
    ("localized_within_1", B),
    ("repair_attempted", B),
    ("repair_passed", B),
    ("e2e_ran", B),
    ("e2e_passed", B),
    ("e2e_note", S),
    ("static_parses", B),
    ("static_has_assert", B),
    ("static_no_network", B),
    ("selectors_robust", B),
    *((name, B) for name in PATTERN_FLAGS),
    ("pattern_used", D),
    ("pattern_attempted", B),
    ("locator_quality", D),
    ("assertion_quality", D),
    ("waiting_quality", D),
    ("uses_arbitrary_timeout", B),
    ("teardown_hygiene", D),
    ("uses_unique_data", B),
    ("uses_hardcoded_url", B),
    ("uses_fragile_selector", B),
    ("has_code_smell", B),
    ("dry_score", D),
    ("hallucinated", B),
    ("hallucination_note", S),
    ("design_judge", D),
    ("design_note", S),
    *(
        (f"review_{name}{suffix}", dtype)
        for name in fixed.REVIEW_CRITERIA
        for suffix, dtype in (("", D), ("_note", S))
    ),
    ("review_score", D),
    ("explanation_judge", D),
    ("explanation_note", S),
)

PAYLOAD = _struct(
    ("source", S),
    ("module_name", S),
    ("mutants", T.ArrayType(S)),
    ("fault_lines", T.ArrayType(I)),
    ("symptom", S),
    ("test", S),
    ("requirement", S),
    (
        "reference",
        _struct(("equivalence_classes", T.ArrayType(S)), ("boundary_values", T.ArrayType(I))),
    ),
    ("flow", S),
    ("base_url", S),
    ("success", S),
    ("expected_pattern", S),
    ("broken_test", S),
    ("error", S),
)

SAMPLES = _struct(("track", S), ("sample_id", S), ("language", S), ("payload", PAYLOAD))

SAMPLE_META = _struct(
    ("module_name", S),
    ("fault_lines", T.ArrayType(I)),
    ("symptom", S),
    ("base_url", S),
    ("success_assertion", S),
    ("expected_pattern", S),
)

MODELS = _struct(
    ("slug", S),
    ("id", S),
    ("provider", S),
    ("label", S),
    ("input_cost_per_mtok", D),
    ("output_cost_per_mtok", D),
    ("context_override", I),
    ("skip_by_default", B),
    ("params_b", D),
)

EXEC_RESULTS = _struct(
    *KEY,
    ("exit_code", I),
    ("stdout", S),
    ("stderr", S),
    ("timed_out", B),
    ("duration_s", D),
)

# The one-line JSON a unit-test runner prints after the marker.
RUNNER_BLOB = _struct(
    ("tests_total", D),
    ("tests_passed", D),
    ("tests_failing_on_correct", D),
    ("collection_ok", B),
    ("coverage_pct", D),
    ("mutants_total", D),
    ("mutants_killed", D),
)

MANIFEST = _struct(
    ("run_id", S),
    ("models", T.ArrayType(MODELS)),
    ("tracks", T.ArrayType(S)),
    ("prompt_hashes", T.MapType(S, S)),
    ("shots", I),
    ("trials", I),
    ("temperature", D),
    ("judge_model", S),
    ("total_tasks", L),
)

GOLDEN_KEY = _struct(
    ("item", I),
    ("sample_id", S),
    ("expected_pattern", S),
    ("model_slug", S),
    ("trial", I),
    ("auto_pattern_used", B),
    ("auto_e2e_passed", B),
)

# Usage block of a stored chat-completion reply.
CHAT_REPLY = _struct(
    ("choices", T.ArrayType(_struct(("message", _struct(("content", S)))))),
    ("usage", _struct(("prompt_tokens", L), ("completion_tokens", L))),
)


def summary_schema(metric_names) -> T.StructType:
    """The summary table for a set of metric names, in registry order."""
    return _struct(
        ("model_slug", S),
        ("track", S),
        ("n_samples", L),
        ("n_trials", L),
        *((name, D) for name in metric_names),
        ("composite_std", D),
        ("tier", S),
    )
