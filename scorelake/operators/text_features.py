"""The text job: every static signal of generated code in one shuffle-free projection.

Works in layers (stripped code, then counts and flags, then scores) so that each
layer's columns are computed once and reused by the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.functions import craft, detectors
from scorelake.functions.lexing import braces_balance, strip_comments, strip_noise
from scorelake.functions.parsing import code_block, with_json_object
from scorelake.functions.python_syntax import python_parses


def parse_output(df: DataFrame, raw: str = "raw_output") -> DataFrame:
    """Adds ``code`` for code tracks and ``parsed``, which is JSON text for the others.

    ``code`` stays free of Python: it is NULL on JSON tracks, and only their texts
    reach the Python check.
    """
    unit, e2e = "track = 'unit_test_gen'", f"track IN {fixed.E2E_TRACKS}"
    text = F.expr(f"coalesce({raw}, '')")
    code = F.when(F.expr(unit), code_block(text, fixed.CODE_LANGUAGES["python"])).when(
        F.expr(e2e), code_block(text, fixed.CODE_LANGUAGES["typescript"])
    )
    df = df.withColumns({"code": code, "_reply": F.expr(f"if({unit} OR {e2e}, NULL, {raw})")})
    df = with_json_object(df, "_reply", "_json").drop("_reply")
    return df.withColumn("parsed", F.expr("coalesce(code, _json)")).drop("_json")


def with_scans(df: DataFrame, code: str = "parsed") -> DataFrame:
    """Adds ``_code`` (comments removed) and ``_bare`` (literals removed as well)."""
    text = F.col(code)
    return df.withColumns({"_code": strip_comments(text), "_bare": strip_noise(text)})


def drop_scans(df: DataFrame) -> DataFrame:
    return df.drop("_code", "_bare")


def with_static_tests(df: DataFrame, code: str, bare: str | None = None) -> DataFrame:
    """Adds the static test signals: Python syntax, or brace balance when ``bare`` is named."""
    text = F.col(code)
    parses = python_parses(text) if bare is None else braces_balance(text, F.col(bare))
    return df.withColumns(
        {
            "static_parses": parses,
            "static_has_assert": detectors.has_assert(text),
            "static_no_network": detectors.no_network(text),
        }
    )


def with_patterns(df: DataFrame, expected: str = "expected_pattern") -> DataFrame:
    """Adds the ``uses_*`` flags, ``pattern_used`` and ``pattern_attempted``; needs the scans."""
    flags = detectors.pattern_flags(F.col("_code"), F.col("_bare"))
    df = df.withColumns(flags)
    columns = {name: F.col(name) for name in flags}
    df = df.withColumn(
        "pattern_attempted", detectors.pattern_attempted(F.col(expected), columns)
    )
    strength = detectors.pattern_strength(
        F.col(expected), F.col("_bare"), F.col("pattern_attempted")
    )
    return df.withColumn("pattern_used", strength)


def with_craft(df: DataFrame) -> DataFrame:
    """Adds the craft signals; needs the scans."""
    code, bare = F.col("_code"), F.col("_bare")
    counts = craft.locator_counts(code)
    df = df.withColumns({f"_{name}": count for name, count in counts.items()}).withColumns(
        {
            "uses_arbitrary_timeout": craft.arbitrary_timeout(bare),
            "_statements": craft.statements(code),
        }
    )
    fragile = F.col("_n_brittle") > 0
    df = df.withColumns(
        {
            "locator_quality": craft.locator_quality({n: F.col(f"_{n}") for n in counts}),
            "assertion_quality": craft.assertion_quality(bare),
            "waiting_quality": craft.waiting_quality(bare, F.col("uses_arbitrary_timeout")),
            "teardown_hygiene": craft.teardown_hygiene(bare),
            "uses_unique_data": craft.unique_data(bare),
            "uses_hardcoded_url": craft.hardcoded_url(code),
            "uses_fragile_selector": fragile,
            "has_code_smell": craft.code_smell(fragile, bare),
            "dry_score": craft.dry_score(F.col("_statements")),
        }
    )
    return df.drop("_statements", *(f"_{n}" for n in counts))


def e2e_features(df: DataFrame, code: str = "parsed", expected: str = "expected_pattern") -> DataFrame:
    """Patterns, craft and selector robustness of end-to-end tests in one projection."""
    df = with_scans(df, code)
    df = with_craft(with_patterns(df, expected))
    return drop_scans(
        df.withColumn("selectors_robust", detectors.selectors_robust(F.col("_code")))
    )


def only_for(df: DataFrame, rows: str, names) -> DataFrame:
    """NULL in the named columns outside the given rows."""
    return df.withColumns({n: F.expr(f"if({rows}, `{n}`, NULL)") for n in names})
