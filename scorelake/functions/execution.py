"""Verdicts from stored execution logs. Logs are an input; nothing is run here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake import schemas
from scorelake.functions.values import strip


def tail(text: Column, chars: int) -> Column:
    """Last ``chars`` characters."""
    return F.right(text, F.lit(chars))


def head(text: Column, chars: int) -> Column:
    """First ``chars`` characters."""
    return F.left(text, F.lit(chars))


def _log_tail(stdout: Column, stderr: Column, chars: int) -> Column:
    """Tail of stderr, or of stdout when stderr is empty."""
    return tail(F.coalesce(F.nullif(stderr, F.lit("")), stdout, F.lit("")), chars)


def runner_blob(stdout: Column, marker: str = fixed.RESULT_MARKER) -> Column:
    """The runner's one-line JSON after the marker as a struct; NULL when absent or bad."""
    position = F.locate(marker, stdout)
    rest = strip(F.substr(stdout, position + F.lit(len(marker))))
    line = F.regexp_extract(rest, r"^([^\n\r]*)", 1)
    blob = F.from_json(line, schemas.RUNNER_BLOB)
    valid = (position > 0) & F.startswith(line, F.lit("{")) & F.try_parse_json(line).isNotNull()
    nonempty = ~line.rlike(r"^\{\s*\}")
    return F.when(valid & nonempty, blob)


def with_blob(df: DataFrame, stdout: str, marker: str = fixed.RESULT_MARKER) -> DataFrame:
    """Adds ``_blob``, the parsed runner line; the verdict columns read it many times."""
    return df.withColumn("_blob", runner_blob(F.col(stdout), marker))


def unit_verdict(stdout: str, stderr: str, n_mutants: str) -> dict[str, Column]:
    """Unit-test columns of a scored row; needs ``_blob``.

    ``mutants_killed`` is NULL when the run failed.
    """
    counts = ("tests_total", "tests_failing_on_correct", "mutants_total", "mutants_killed")
    # A log whose counts are no counts is a bad log, like one without a result.
    sound = " AND ".join(f"(_blob.{n} IS NULL OR try_cast(_blob.{n} AS INT) IS NOT NULL)" for n in counts)
    ok = f"(_blob IS NOT NULL AND {sound})"

    def count(name: str) -> str:
        return f"coalesce(try_cast(_blob.{name} AS INT), 0)"

    total, failing = count("tests_total"), count("tests_failing_on_correct")
    mutants, killed = count("mutants_total"), count("mutants_killed")
    valid = f"{ok} AND coalesce(_blob.collection_ok, false) AND {failing} = 0 AND {total} > 0"
    log = f"coalesce(nullif({stderr}, ''), {stdout}, '')"
    columns = {
        "exec_ok": ok,
        "tests_total": f"if({ok}, {total}, 0)",
        "tests_failing_on_correct": f"if({ok}, {failing}, 0)",
        "mutants_total": f"if({ok}, {mutants}, {n_mutants})",
        "mutants_killed": f"if({ok}, {killed}, NULL)",
        "mutants_surviving": f"if({ok}, {mutants} - {killed}, {n_mutants})",
        "coverage_pct": f"if({ok}, coalesce(_blob.coverage_pct, 0D), 0D)",
        "runs_and_valid": valid,
        "passed": valid,
        "exec_error": f"if({ok}, NULL, right({log}, {fixed.EXEC_ERROR_CHARS}))",
    }
    return {name: F.expr(text) for name, text in columns.items()}


def unit_feedback(verdict: dict[str, Column]) -> Column:
    """Feedback text for a failed attempt, empty for a passed one."""
    return (
        F.when(verdict["passed"], F.lit(""))
        .when(
            ~verdict["exec_ok"],
            F.concat(F.lit(fixed.FEEDBACK_RUN_FAILED), verdict["exec_error"]),
        )
        .otherwise(
            F.concat(
                verdict["tests_failing_on_correct"].cast("string"),
                F.lit(fixed.FEEDBACK_FALSE_ALARM),
            )
        )
    )


def test_tally(log: Column, double_count_errors: bool = False) -> dict[str, Column]:
    """Counts from a test runner's text summary.

    ``double_count_errors`` reproduces a quirk of the original tally, where
    "2 errors" matches both the singular and the plural word.
    """

    def count(word: str) -> Column:
        digits = F.regexp_extract(log, rf"(\d+) {word}", 1).try_cast("int")
        return F.coalesce(digits, F.lit(0))

    errors = count("error") + count("errors") if double_count_errors else count("error")
    passed, failed = count("passed"), count("failed")
    return {
        "n_passed": passed,
        "n_failed": failed,
        "n_errors": errors,
        "n_total": passed + failed + errors,
        "n_failing": failed + errors,
    }


def browser_verdict(
    exit_code: Column, timed_out: Column, stdout: Column, stderr: Column
) -> dict[str, Column]:
    """End-to-end columns: it ran on exit 0 or 1 in time, it passed on exit 0."""
    ran = F.coalesce(exit_code.isin(0, 1), F.lit(False)) & ~F.coalesce(timed_out, F.lit(False))
    passed = ran & (exit_code == 0)
    note = F.when(ran, F.lit("")).otherwise(_log_tail(stdout, stderr, fixed.E2E_NOTE_CHARS))
    return {"e2e_ran": ran, "e2e_passed": passed, "passed": passed, "e2e_note": note}


def gateway_script(script: Column, base_url: Column) -> Column:
    """The script with its base-URL token filled and local hosts sent to the gateway."""
    filled = F.replace(script, F.lit(fixed.BASE_URL_TOKEN), base_url)
    return F.regexp_replace(filled, F.lit(fixed.LOCAL_HOST), F.lit(fixed.GATEWAY_HOST))


def reset_url(base_url: Column) -> Column:
    """The app's reset address, without a doubled slash."""
    return F.concat(F.rtrim(base_url, F.lit("/")), F.lit("/api/reset"))


def is_transient(status: Column, error: Column) -> Column:
    """Whether a stored failure is worth a retry: transport error, 429 or 5xx."""
    transport = F.coalesce(error.rlike("(?i)transport|timeout|connect"), F.lit(False))
    by_status = (status == 429) | ((status >= 500) & (status < 600))
    return F.coalesce(by_status, transport)
