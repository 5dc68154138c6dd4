"""Bug-localization rules: predicted span, hits, pass rule, patch assembly."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.values import named, strip


def covers(start: Column, end: Column, fault_lines: Column, slack: int = 0) -> Column:
    """Whether every known fault line lies in the span widened by ``slack``."""
    inside = F.forall(fault_lines, lambda f: f.between(start - F.lit(slack), end + F.lit(slack)))
    known = F.coalesce(F.size(fault_lines), F.lit(0)) > 0
    return F.coalesce(start.isNotNull() & known & inside, F.lit(False))


def localization_pass(exact: Column, near: Column, repair_ok: Column) -> Column:
    """Exact hit, or a near hit whose repair worked. ``repair_ok`` NULL: not attempted."""
    return exact | (near & F.coalesce(repair_ok, F.lit(False)))


# What ends a line, as for Python's splitlines.
_OTHER_LINE_END = r"[\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}](?:(?<=\r)\n)?"


def split_lines(text: Column) -> Column:
    """Lines of a text without a trailing empty line, like Python's splitlines."""
    # A split at one plain character compiles no pattern per row.
    lines = F.split(F.regexp_replace(text, _OTHER_LINE_END, "\n"), "\n")

    def without_last(found: Column) -> Column:
        n = F.size(found)
        return F.when(F.get(found, n - F.lit(1)) == "", F.slice(found, F.lit(1), n - F.lit(1))).otherwise(found)

    return F.when(text == "", F.array().cast("array<string>")).otherwise(named(lines, without_last))


def repair_due(
    lines: Column, start: Column, end: Column, fix: Column, test: Column, module_name: Column
) -> Column:
    """Whether a repair can be tried: a test, a fix, and a span inside the source."""
    return (
        (F.coalesce(test, F.lit("")) != "")
        & (F.coalesce(module_name, F.lit("")) != "")
        & fix.isNotNull()
        & (start >= 1)
        & (end <= F.size(lines))
    )


def fix_block(lines: Column, start: Column, end: Column, fix: Column) -> Column:
    """Lines of the fix; a lone unindented line takes over the replaced line's indent."""
    fix_lines = F.when(fix == "", F.array(F.lit(""))).otherwise(split_lines(fix))
    indent = F.regexp_extract(F.get(lines, start.cast("int") - F.lit(1)), r"(?U)^(\s*)", 1)

    def indented(block: Column) -> Column:
        line = F.get(block, F.lit(0))
        lone = (start == end) & (F.size(block) == 1) & ~line.rlike(r"^[ \t]")
        return F.when(lone, F.array(F.concat(indent, strip(line)))).otherwise(block)

    return named(fix_lines, indented)


def replace_lines(lines: Column, start: Column, end: Column, block: Column) -> Column:
    """The source text with lines start..end replaced by the block."""
    first, last = start.cast("int"), end.cast("int")
    before = F.slice(lines, F.lit(1), first - F.lit(1))
    after = F.slice(lines, last + F.lit(1), F.size(lines) - last)
    return F.concat(F.array_join(F.concat(before, block, after), "\n"), F.lit("\n"))


def numbered_listing(source: Column) -> Column:
    """The source with right-aligned line numbers, as shown in prompts."""

    def number(line: Column, i: Column) -> Column:
        n = (i + F.lit(1)).cast("string")
        return F.concat(F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit(" ")), F.lit("  "), line)

    return F.array_join(F.transform(split_lines(source), number), "\n")
