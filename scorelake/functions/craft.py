"""Craft signals of a generated end-to-end test: locators, assertions, waits, reuse."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.functions.detectors import may_be_brittle
from scorelake.functions.matching import found, mentions, mentions_any_case, occurrences
from scorelake.functions.values import strip

_TIER_NEEDLES = (("getByRole",), ("getByLabel",), ("getBy",), ("getByTestId",))


def locator_counts(code: Column) -> dict[str, Column]:
    """Number of locators of each strategy, plus the brittle selector count."""
    names = ("n_role", "n_label", "n_text", "n_testid")
    counts = {
        name: occurrences(code, pattern, needles)
        for name, (pattern, _), needles in zip(
            names, fixed.LOCATOR_TIERS, _TIER_NEEDLES, strict=True
        )
    }
    counts["n_css"] = occurrences(code, fixed.CSS_LOCATOR, (".locator",))
    # NULL code has a NULL count.
    brittle = occurrences(code, fixed.BRITTLE_SELECTOR)
    counts["n_brittle"] = F.when(~may_be_brittle(code), F.lit(0)).otherwise(brittle)
    return counts


def locator_quality(counts: dict[str, Column]) -> Column:
    """Mean weight of the locators used; NULL when the code has none."""
    css = F.greatest(F.lit(0), counts["n_css"] - counts["n_brittle"])
    weighted, total = F.lit(0.0), F.lit(0)
    for name, (_, weight) in zip(counts, fixed.LOCATOR_TIERS, strict=False):
        weighted = weighted + counts[name] * F.lit(weight)
        total = total + counts[name]
    weighted = weighted + (
        css * F.lit(fixed.CSS_WEIGHT) + counts["n_brittle"] * F.lit(fixed.BRITTLE_WEIGHT)
    )
    total = total + css + counts["n_brittle"]
    return weighted / F.nullif(total, F.lit(0))


def assertion_quality(bare: Column) -> Column:
    """Share of assertions that retry by themselves; NULL when there are none."""
    good = occurrences(bare, fixed.WEB_FIRST_ASSERT, (".to",))
    manual = occurrences(bare, fixed.MANUAL_ASSERT, ("expect", ".status"))
    return good / F.nullif(good + manual, F.lit(0))


def arbitrary_timeout(bare: Column) -> Column:
    return found(bare, fixed.ARBITRARY_WAIT, ("waitForTimeout", "setTimeout", "sleep"))


def waiting_quality(bare: Column, arbitrary: Column) -> Column:
    """1 for event-based waits only, 0.5 mixed, 0 for fixed sleeps only, else NULL."""
    good = found(bare, fixed.GOOD_WAIT, ("waitFor", "expect.poll", ".to"))
    return F.when(good, F.when(arbitrary, 0.5).otherwise(1.0)).when(arbitrary, 0.0)


def teardown_hygiene(bare: Column) -> Column:
    """1 or 0 by cleanup when the test sets shared state up; NULL when it does not."""
    needs = found(bare, fixed.NEEDS_TEARDOWN, (".on", "addListener", "beforeAll", "newContext"))
    cleanup = ("after", ".off", "removeListener", "removeAllListeners", ".close", "clearCookies")
    return F.when(needs, F.when(found(bare, fixed.HAS_TEARDOWN, cleanup), 1.0).otherwise(0.0))


def unique_data(bare: Column) -> Column:
    unique = ("Date.now", "randomUUID", "crypto.", "Math.random", "nanoid", "faker.")
    return found(bare, fixed.UNIQUE_DATA, unique) | found(
        bare, fixed.LENGTH_DELTA, (".length", "toHaveCount")
    )


def hardcoded_url(code: Column) -> Column:
    calls = mentions_any_case(code, ("goto", "fetch", "route", "tfor", "overcdp", "reque"))
    return F.contains(code, F.lit("://")) & calls & found(code, fixed.HARDCODED_URL)


_SMELL_NEEDLES = (
    ("querySelector", "document."),
    (".evaluate",),
    (".$", "page.$"),
    (".isVisible", ".isHidden", ".textContent"),
)


def code_smell(fragile: Column, bare: Column) -> Column:
    """A brittle selector, or one of the DOM-reaching smells."""
    smells = [
        found(bare, pattern, needles)
        for pattern, needles in zip(fixed.SMELLS, _SMELL_NEEDLES, strict=True)
    ]
    return reduce(or_, smells, fragile)


def statements(code: Column) -> Column:
    """Statements that start with await or expect, whitespace-normalised."""
    # (?d): only \n ends a line, as in the data's own line convention.
    lines = F.regexp_extract_all(
        code, F.lit(r"(?Umd)^\s*(await\s+.+|expect\s*\(.+)$"), F.lit(1)
    )
    tidy = F.transform(
        lines, lambda s: strip(F.regexp_replace(s, F.lit(r"(?U)\s+"), F.lit(" ")))
    )
    return F.when(mentions(code, ("await", "expect")), tidy).otherwise(
        F.array().cast("array<string>")
    )


def dry_score(stmts: Column) -> Column:
    """1 minus the share of repeated statements; NULL below four statements."""
    total = F.size(stmts)
    repeated = total - F.size(F.array_distinct(stmts))
    return F.when(total >= fixed.DRY_MIN_STATEMENTS, F.lit(1.0) - repeated / total)
