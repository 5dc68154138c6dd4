"""Regex tests with a cheap literal guard in front.

Most texts hold none of a pattern's keywords. ``contains`` scans the UTF-8 bytes
without decoding them, so a guard on the keywords spares the regex engine (and the
byte-to-character conversion it needs) for those texts. Every match of a pattern
must contain at least one of its needles.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def unicode_classes(pattern: str) -> str:
    """The pattern with Unicode-aware \\w, \\s and \\b."""
    return "(?U)" + pattern


def mentions(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether the text contains any of the literal needles."""
    return reduce(or_, (F.contains(text, F.lit(n)) for n in needles))


def found(text: Column, pattern: str, needles: tuple[str, ...] = ()) -> Column:
    """Whether the pattern occurs in the text."""
    test = F.regexp_like(text, F.lit(unicode_classes(pattern)))
    return (mentions(text, needles) & test) if needles else test


def occurrences(text: Column, pattern: str, needles: tuple[str, ...] = ()) -> Column:
    """Number of non-overlapping matches of the pattern."""
    count = F.regexp_count(text, F.lit(unicode_classes(pattern)))
    return F.when(mentions(text, needles), count).otherwise(F.lit(0)) if needles else count


def mentions_any_case(text: Column, needles: tuple[str, ...]) -> Column:
    """Whether the text contains any of the lower-case needles in any case.

    Needles must not hold i, k or s: other letters of Unicode match these whatever the case.
    """
    return mentions(F.lower(text), needles)
