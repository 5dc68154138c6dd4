"""Comment and string stripping for generated TypeScript/JavaScript.

The lexer pattern is written with possessive quantifiers. The usual form
``(?:\\\\.|[^"\\\\])*`` recurses once per character in the JVM regex engine, and a
long literal overflows the executor's stack; the unrolled form runs in a loop.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scorelake.functions.matching import mentions
from scorelake.functions.values import strip

# What string literals and comments look like.
_STRING = (
    r'"[^"\\]*+(?:\\.[^"\\]*+)*+"'
    r"|'[^'\\]*+(?:\\.[^'\\]*+)*+'"
    r"|`[^`\\]*+(?:\\.[^`\\]*+)*+`"
)
_COMMENT = r"//[^\n]*+|/\*.*?\*/"
_LITERAL_OR_COMMENT = f"(?s){_STRING}|{_COMMENT}"
# What stands before a comment, token by token, and the comment. A possessive group runs in a loop; \G keeps
# the search from starting again inside a literal.
_UP_TO_COMMENT = f"(?s)\\G((?:{_STRING}|[^\"'`/]++|(?!//|/\\*.*?\\*/).)*+)(?:{_COMMENT})"


def strip_comments(code: Column) -> Column:
    """Replace every comment by one space; string literals stay as they are."""
    kept = F.regexp_replace(code, F.lit(_UP_TO_COMMENT), F.lit("$1 "))
    return F.when(mentions(code, ("//", "/*")), kept).otherwise(code)


def strip_noise(code: Column) -> Column:
    """Replace every comment and every string or template literal by one space."""
    return F.regexp_replace(code, F.lit(_LITERAL_OR_COMMENT), F.lit(" "))


def braces_balance(code: Column, bare: Column) -> Column:
    """Light syntax check: equal brace counts in the stripped code, and not blank."""
    opened = F.length(bare) - F.length(F.translate(bare, "{", ""))
    closed = F.length(bare) - F.length(F.translate(bare, "}", ""))
    return (opened == closed) & (strip(code) != "")
