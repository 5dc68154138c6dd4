"""Technique detectors over generated test code.

Token detectors run on ``bare`` code (comments and literals removed), detectors
whose signal sits in a string argument on ``code`` (only comments removed).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.functions.matching import found, mentions_any_case


def has_assert(text: Column) -> Column:
    return found(text, fixed.HAS_ASSERT, ("assert", "expect"))


def no_network(text: Column) -> Column:
    needles = ("socket", "requests", "urllib", "httpx", "subprocess")
    return ~found(text, fixed.FORBIDDEN_IMPORT, needles)


def may_be_brittle(code: Column) -> Column:
    """Holds for every code with a brittle selector, at a lower price than the pattern, which ignores case."""
    path = F.contains(code, F.lit("//")) & F.contains(code, F.lit("["))
    return path | mentions_any_case(code, ("nth-c", 'xpath="'))


def fragile_selector(code: Column) -> Column:
    return may_be_brittle(code) & found(code, fixed.BRITTLE_SELECTOR)


def selectors_robust(code: Column) -> Column:
    """A resilient locator is present and no brittle one."""
    robust = found(code, fixed.ROBUST_SELECTOR, ("getBy", "data-testid"))
    return robust & ~fragile_selector(code)


def page_object(bare: Column) -> Column:
    """A class that wraps a page: by its name, or by holding one."""
    named = found(bare, fixed.PAGE_CLASS_NAMED, ("Page",))
    wraps = found(bare, fixed.WRAPS_PAGE, ("Page", "this.page")) & found(bare, fixed.PAGE_CLASS)
    return F.contains(bare, F.lit("class")) & (named | wraps)


def structure(bare: Column) -> Column:
    """Any reusable structure: page object, page helper, or screenplay."""
    screenplay = ("actor", "attemptsTo", "Actor", "Task", "Ability", "answeredBy", "performAs")
    helper = F.contains(bare, F.lit("page")) & (
        found(bare, fixed.HELPER_FUNCTION, ("function",))
        | found(bare, fixed.HELPER_ARROW, ("=>",))
    )
    return page_object(bare) | helper | found(bare, fixed.SCREENPLAY, screenplay)


def fixtures(bare: Column) -> Column:
    needles = (".extend", "storageState", "dependencies", "beforeAll")
    return found(bare, fixed.FIXTURES, needles)


def network(bare: Column) -> Column:
    return found(bare, fixed.NETWORK, ("route",))


def polling(bare: Column) -> Column:
    needles = ("expect.poll", ".to", "waitFor")
    return found(bare, fixed.POLLING, needles)


def api(bare: Column) -> Column:
    return found(bare, fixed.API, ("request", "APIRequestContext"))


def download(code: Column) -> Column:
    needles = ("download", "suggestedFilename")
    return found(code, fixed.DOWNLOAD, needles)


def accessibility(bare: Column) -> Column:
    needles = ("AxeBuilder", "@axe-core/playwright", "axe.run", ".accessibility.snapshot")
    return found(bare, fixed.ACCESSIBILITY, needles)


def performance(bare: Column) -> Column:
    needles = ("performance.", "PerformanceObserver", "web-vitals", "lighthouse")
    return found(bare, fixed.PERFORMANCE, needles)


def realtime(bare: Column) -> Column:
    needles = ("routeWebSocket", "WebSocketRoute", "createCDPSession", "CDPSession")
    return found(bare, fixed.REALTIME, needles)


def pattern_flags(code: Column, bare: Column) -> dict[str, Column]:
    """Every ``uses_*`` flag by name."""
    return {
        "uses_structure": structure(bare),
        "uses_page_object": page_object(bare),
        "uses_fixtures": fixtures(bare),
        "uses_polling": polling(bare),
        "uses_network": network(bare),
        "uses_api": api(bare),
        "uses_download": download(code),
        "uses_accessibility": accessibility(bare),
        "uses_performance": performance(bare),
        "uses_realtime": realtime(bare),
    }


def pattern_attempted(expected: Column, flags: dict[str, Column]) -> Column:
    """Whether the expected technique was touched; unknown or no name gives false."""
    attempted = F.lit(False)
    for name, flag in flags.items():
        attempted = F.when(expected == name.removeprefix("uses_"), flag).otherwise(attempted)
    return attempted


def pattern_strength(expected: Column, bare: Column, attempted: Column) -> Column:
    """Graded credit 1 / 0.5 / 0 for the expected technique; NULL if none expected."""
    needles = ("expect.poll", ".toPass", "waitFor")
    polling_credit = F.when(found(bare, fixed.POLLING_PROPER, needles), 1.0).otherwise(0.5)
    fixtures_credit = (
        F.when(found(bare, fixed.FIXTURES_STRONG, (".extend", "dependencies")), 1.0)
        .when(found(bare, fixed.FIXTURES_HOOK, ("before",)), 0.5)
        .when(F.contains(bare, F.lit(fixed.FIXTURES_STATE)), 1.0)
        .otherwise(0.0)
    )
    credit = (
        F.when(expected == "polling", polling_credit)
        .when(expected == "fixtures", fixtures_credit)
        .otherwise(1.0)
    )
    none_expected = F.coalesce(expected, F.lit("")) == ""
    return F.when(none_expected, F.lit(None).cast("double")).otherwise(
        F.when(attempted, credit).otherwise(0.0)
    )
