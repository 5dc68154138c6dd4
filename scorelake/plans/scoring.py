"""Responses to scored rows to summary, as one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import fixed_values as fixed
from scorelake import schemas
from scorelake.functions import execution
from scorelake.functions.localization import localization_pass
from scorelake.functions.values import required
from scorelake.operators import localize, rejudge, text_features
from scorelake.operators.planning import without_done

_KEY = list(fixed.KEY_COLUMNS)

Scorer = Callable[[DataFrame], DataFrame]


def base_rows(responses: DataFrame) -> DataFrame:
    """The base columns of a scored row with their defaults, and the raw output.

    A missing or zero trial is 0, missing or zero attempts are 1.
    """
    return responses.select(
        "model_slug",
        F.expr("coalesce(provider, '')").alias("provider"),
        "track",
        "sample_id",
        F.expr("coalesce(trial, 0)").alias("trial"),
        F.expr("coalesce(nullif(attempts, 0), 1)").alias("attempts"),
        *(F.expr(f"coalesce({c}, 0)").alias(c) for c in ("tokens_in", "tokens_out")),
        *(F.expr(f"coalesce({c}, 0D)").alias(c) for c in ("latency_s", "cost")),
        F.expr("coalesce(raw_output, '')").alias("raw_output"),
    )


def pending(responses: DataFrame, scored: DataFrame | None, rescore: bool = False) -> DataFrame:
    """Responses still to be scored; ``rescore`` takes them all."""
    return responses if rescore or scored is None else without_done(responses, scored)


def with_samples(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Rows with language and payload of their sample; an unknown sample is an error.

    The sample side is small next to the responses, so the optimizer broadcasts it
    when its measured size allows and shuffles otherwise.
    """
    sides = samples.select("track", "sample_id", "payload", F.lit(True).alias("_known"))
    joined = rows.join(sides, ["track", "sample_id"], "left")
    message = F.concat_ws("/", F.lit("unknown sample"), "track", "sample_id")
    return required(joined, F.col("_known").isNotNull(), message).drop("_known")


def unknown_samples(rows: DataFrame, samples: DataFrame) -> DataFrame:
    """Keys of responses whose sample the dataset does not have."""
    return rows.select("track", "sample_id").distinct().join(
        samples.select("track", "sample_id"), ["track", "sample_id"], "left_anti"
    )


def _read_logs(exec_results: DataFrame, marker: str) -> DataFrame:
    """Execution logs as they are joined: result lines, which only unit tests have, are parsed beforehand."""
    logs = exec_results.select(
        *_KEY,
        F.col("exit_code").alias("_exit"),
        F.col("timed_out").alias("_timed_out"),
        F.col("stdout").alias("_stdout"),
        F.col("stderr").alias("_stderr"),
        F.expr("if(track = 'unit_test_gen', stdout, NULL)").alias("_line"),
    )
    return execution.with_blob(logs, "_line", marker).drop("_line")


def _with_execution(rows: DataFrame) -> DataFrame:
    """Verdict columns of every track out of the joined execution log."""
    unit, bug = "track = 'unit_test_gen'", "track = 'bug_localization'"
    e2e = f"track IN {fixed.E2E_TRACKS}"
    unit_columns = execution.unit_verdict("_stdout", "_stderr", "_n_mutants")
    browser = execution.browser_verdict(
        F.col("_exit"), F.col("_timed_out"), F.col("_stdout"), F.col("_stderr")
    )
    # Each track has its own columns; `passed` is the one they share.
    columns = {n: F.when(F.expr(unit), c) for n, c in unit_columns.items() if n != "passed"}
    columns.update({n: F.when(F.expr(e2e), c) for n, c in browser.items() if n != "passed"})
    columns["repair_attempted"] = F.expr(f"if({bug}, _repairable, NULL)")
    columns["repair_passed"] = F.expr(
        f"if({bug}, _repairable AND coalesce(_exit = 0, false), NULL)"
    )
    rows = rows.withColumns(columns)
    return rows.withColumn(
        "passed",
        F.when(F.expr(unit), F.col("runs_and_valid"))
        .when(F.expr(e2e), F.col("e2e_passed"))
        .when(
            F.expr(bug),
            localization_pass(
                F.col("localized"), F.col("localized_within_1"), F.col("repair_passed")
            ),
        ),
    )


def score(
    responses: DataFrame,
    samples: DataFrame,
    exec_results: DataFrame,
    replies: DataFrame,
    judge_model: str,
    python_check: bool = True,
    marker: str = fixed.RESULT_MARKER,
    scorers: Sequence[Scorer] = (),
) -> DataFrame:
    """Scored rows of the responses: the declared wide schema, then the scorers' own columns.

    Text features run in the scan's own stage; then one join with the execution
    logs on the key and one per judge with the replies on the request key. ``marker``
    stands before the result line in the logs of unit tests. Each scorer adds columns to
    rows that hold the key, ``raw_output``, ``parsed``, ``code`` and ``payload``; one made
    with ``captured`` keeps its row and notes the error when it fails.
    """
    rows = with_samples(base_rows(responses), samples)
    rows = text_features.parse_output(rows)
    given = set(rows.columns)
    for scorer in scorers:
        rows = scorer(rows)
    own = [c for c in rows.columns if c not in given]
    e2e, patterned = f"track IN {fixed.E2E_TRACKS}", f"track IN {fixed.PATTERN_TRACKS}"
    unit, bug = "track = 'unit_test_gen'", "track = 'bug_localization'"

    # NULL code costs no pattern search, so each group of signals sees its own tracks.
    rows = rows.withColumns(
        {
            "_unit_code": F.expr(f"if({unit}, code, NULL)"),
            "_e2e_code": F.expr(f"if({e2e}, code, NULL)"),
            "_expected": F.expr(f"if({patterned}, payload.expected_pattern, NULL)"),
        }
    )
    if python_check:
        rows = text_features.with_static_tests(rows, "_unit_code")
    rows = rows.drop("_unit_code", "code", "raw_output")

    rows = rows.withColumn("_document", F.expr(f"if({bug}, parsed, NULL)"))
    rows = localize.with_hits(
        localize.with_span(rows, "_document"), F.col("payload.fault_lines")
    )
    hits = ["predicted_line", "predicted_end_line", "localized", "localized_within_1"]
    rows = text_features.only_for(localize.with_patch(rows, "_document"), bug, hits)

    # Prompts and payloads are settled here, before the many layers of the pattern search, which would carry them.
    rows = rejudge.with_request_keys(rows, judge_model).withColumns(
        {
            "_repairable": F.expr("patched IS NOT NULL"),
            "_n_mutants": F.expr("greatest(coalesce(size(payload.mutants), 0), 0)"),
        }
    )
    rows = rows.drop("parsed", "_document", "_start", "_end", "payload", "patched")

    rows = text_features.with_scans(rows, "_e2e_code")
    rows = text_features.with_craft(text_features.with_patterns(rows, "_expected"))
    rows = rows.withColumn(
        "selectors_robust", text_features.detectors.selectors_robust(F.col("_code"))
    )
    patterns = [*schemas.PATTERN_FLAGS, "pattern_used", "pattern_attempted"]
    rows = text_features.only_for(rows, patterned, patterns)
    rows = text_features.only_for(rows, "track = 'e2e_ui'", ["selectors_robust"])
    rows = text_features.drop_scans(rows).drop("_expected", "_e2e_code")

    # Only small columns go through the joins.
    rows = _with_execution(rows.join(_read_logs(exec_results, marker), _KEY, "left")).drop(*_LOG)
    rows = rejudge.with_judgements(rows, replies)
    rows = rows.withColumn("passed", F.coalesce("passed", "_design_passed"))
    return rows.select(
        *(
            F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in schemas.SCORED.fields
            if f.name not in own
        ),
        *own,
    )


def captured(name: str, function: Callable[[dict], dict], inputs: Sequence[str], outputs: T.StructType) -> Scorer:
    """A scorer out of a Python function from a row's inputs to its outputs.

    A row on which the function fails keeps its place with NULL outputs and the error's
    text in ``<name>_error``. Rows go through Arrow batches without a shuffle.
    """
    error = f"{name}_error"
    names = [f.name for f in outputs.fields]

    def score_rows(rows: DataFrame) -> DataFrame:
        kind = T.StructType([*outputs.fields, T.StructField(error, T.StringType())])

        def batch(given: pd.DataFrame) -> pd.DataFrame:
            made = []
            for row in given.to_dict("records"):
                try:
                    found = function(row)
                    made.append({**{n: found.get(n) for n in names}, error: None})
                except Exception as failure:  # noqa: BLE001 - recorded in the row
                    made.append({**dict.fromkeys(names), error: f"{type(failure).__name__}: {failure}"})
            return pd.DataFrame(made, columns=[*names, error], dtype=object)

        scored = rows.withColumn("_made", F.pandas_udf(batch, kind)(F.struct(*inputs)))
        return scored.withColumns({n: F.col(f"_made.{n}") for n in (*names, error)}).drop("_made")

    return score_rows


_LOG = ("_exit", "_timed_out", "_stdout", "_stderr", "_blob", "_repairable", "_n_mutants")


def refresh_judgements(
    scored: DataFrame,
    responses: DataFrame,
    samples: DataFrame,
    replies: DataFrame,
    judge_model: str,
) -> DataFrame:
    """Scored rows with fresh judge columns; execution and static columns stay.

    ``passed`` of the design track comes from its judge and is refreshed with it.
    """
    judged = [c for c in rejudge.judge_columns() if c in scored.columns]
    kept = rejudge.drop_stale(scored).drop(*judged)
    rows = with_samples(rejudge.with_raw_outputs(kept, responses), samples)
    rows = text_features.parse_output(rows).drop("raw_output", "code")
    keyed = rejudge.with_request_keys(rows, judge_model).drop("payload", "parsed")
    fresh = rejudge.with_judgements(keyed, replies)
    return fresh.withColumn("passed", F.coalesce("_design_passed", "passed")).drop("_design_passed")
