"""Text queries: code blocks, JSON, lexing, technique detectors, craft, localization."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.catalog import bindings
from scorelake.catalog.bindings import with_bindings
from scorelake.functions import detectors, localization, parsing
from scorelake.functions.lexing import braces_balance, strip_comments, strip_noise
from scorelake.operators import localize, text_features

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_WHITESPACE = _q(fixed.PY_WHITESPACE).replace("\n", "' || chr(10) || '")
_TYPESCRIPT = fixed.CODE_LANGUAGES["typescript"]

# --- The same text rules in SQL -------------------------------------------------

# The block and token rules once more, in the checking engine's dialect.
_BLOCKS = r"(?s)```([a-zA-Z0-9_+-]*)\n(.*?)```"


def _trim(expr: str) -> str:
    return f"trim({expr}, {_WHITESPACE})"


def _code_block_sql(text: str, prefer) -> str:
    langs = f"list_transform(regexp_extract_all({text}, {_q(_BLOCKS)}, 1), lambda x: lower(x))"
    bodies = f"regexp_extract_all({text}, {_q(_BLOCKS)}, 2)"
    wanted = ", ".join(f"{bodies}[list_position({langs}, {_q(w)})]" for w in prefer)
    opened = r"(?s)```[a-zA-Z0-9_+-]*\n(.*)"
    return _trim(
        f"CASE WHEN len({langs}) > 0 THEN coalesce({wanted}, {bodies}[1]) "
        f"WHEN regexp_matches({text}, {_q(opened)}) THEN regexp_extract({text}, {_q(opened)}, 1) ELSE {text} END"
    )


# Likewise for literals and comments.
_STR = r""""(?:\\.|[^"\\])*"|'(?:\\.|[^'\\])*'|`(?:\\.|[^`\\])*`"""
_COM = r"//[^\n]*|/\*.*?\*/"
_LEX = f"(?s){_STR}|{_COM}|[^\"'`/]+|."


def _strip_comments_sql(text: str) -> str:
    return (
        f"array_to_string(list_transform(regexp_extract_all({text}, {_q(_LEX)}), "
        "lambda t: CASE WHEN starts_with(t, '//') OR starts_with(t, '/*') THEN ' ' ELSE t END), '')"
    )


def _strip_noise_sql(text: str) -> str:
    return f"regexp_replace({text}, {_q(f'(?s){_STR}|{_COM}')}, ' ', 'g')"


_PARSED = f"parsed AS (SELECT doc_id, expected_pattern, {_code_block_sql('raw_output', _TYPESCRIPT)} AS code FROM v_texts)"
_SCANS = (
    f"WITH {_PARSED}, scans AS (SELECT *, {_strip_comments_sql('code')} AS no_comments, "
    f"{_strip_noise_sql('code')} AS bare FROM parsed)"
)


def _over_scans(select: str) -> str:
    return with_bindings("texts", f"{_SCANS} {select}")


def _hit(column: str, pattern: str) -> str:
    return f"regexp_matches({column}, {_q(pattern)})"


def _count(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, {_q(pattern)}))"


# --- Parsing and lexing ---------------------------------------------------------


def _parsed(spark, sf_dir) -> DataFrame:
    texts = bindings.model_texts(spark, sf_dir)
    code = parsing.code_block(F.col("raw_output"), _TYPESCRIPT)
    return texts.select("doc_id", "expected_pattern", code.alias("code"))


def _scans(spark, sf_dir) -> DataFrame:
    return text_features.with_scans(_parsed(spark, sf_dir), "code")


def extract_code_block(spark, sf_dir):
    """The code block of every model output."""
    return _parsed(spark, sf_dir).select("doc_id", "code")


SQL["extract_code_block"] = with_bindings("texts", f"WITH {_PARSED} SELECT doc_id, code FROM parsed")


def strip_comments_text(spark, sf_dir):
    """Code without comments."""
    return _scans(spark, sf_dir).select("doc_id", F.col("_code").alias("no_comments"))


SQL["strip_comments_text"] = _over_scans("SELECT doc_id, no_comments FROM scans")


def strip_noise_text(spark, sf_dir):
    """Code without comments and literals."""
    return _scans(spark, sf_dir).select("doc_id", F.col("_bare").alias("bare"))


SQL["strip_noise_text"] = _over_scans("SELECT doc_id, bare FROM scans")


def page_lexing(spark, sf_dir):
    """Both strippers and the brace check over raw web pages."""
    pages = bindings.heavy_table(spark, sf_dir, "pages")
    html = F.col("html")
    scanned = pages.select(
        "page_id", "html", strip_comments(html).alias("no_comments"), strip_noise(html).alias("bare")
    )
    return scanned.select(
        "page_id", "no_comments", "bare", braces_balance(F.col("html"), F.col("bare")).alias("balanced")
    )


_BALANCED = (
    "(len({b}) - len(replace({b}, '{{', '')) = len({b}) - len(replace({b}, '}}', '')) AND {t} <> '')"
)
SQL["page_lexing"] = f"""
WITH scanned AS (SELECT page_id, html, {_strip_comments_sql('html')} AS no_comments, {_strip_noise_sql('html')} AS bare FROM pages)
SELECT page_id, no_comments, bare, {_BALANCED.format(b='bare', t=_trim('html'))} AS balanced FROM scanned"""


def static_tests(spark, sf_dir):
    """Syntax, assertion and import checks of every extracted code block."""
    scans = _scans(spark, sf_dir)
    return text_features.with_static_tests(scans, "code", "_bare").select(
        "doc_id", "static_parses", "static_has_assert", "static_no_network"
    )


SQL["static_tests"] = _over_scans(
    f"""SELECT doc_id, {_BALANCED.format(b='bare', t=_trim('code'))} AS static_parses,
          {_hit('code', fixed.HAS_ASSERT)} AS static_has_assert, NOT {_hit('code', fixed.FORBIDDEN_IMPORT)} AS static_no_network
        FROM scans"""
)


def python_syntax(spark, sf_dir):
    """Python syntax check of every extracted code block (rows only: no SQL twin)."""
    parsed = _parsed(spark, sf_dir)
    return text_features.with_static_tests(parsed, "code").select("doc_id", "static_parses")


def selector_robustness(spark, sf_dir):
    """A resilient locator and no brittle one."""
    return _scans(spark, sf_dir).select(
        "doc_id", detectors.selectors_robust(F.col("_code")).alias("selectors_robust")
    )


SQL["selector_robustness"] = _over_scans(
    f"""SELECT doc_id, {_hit('no_comments', fixed.ROBUST_SELECTOR)} AND NOT {_hit('no_comments', fixed.BRITTLE_SELECTOR)} AS selectors_robust
        FROM scans"""
)

# --- Detectors ------------------------------------------------------------------

_PAGE_OBJECT = (
    f"({_hit('bare', fixed.PAGE_CLASS_NAMED)} OR "
    f"({_hit('bare', fixed.PAGE_CLASS)} AND {_hit('bare', fixed.WRAPS_PAGE)}))"
)
_DETECTOR_SQL = {
    "uses_structure": f"({_PAGE_OBJECT} OR {_hit('bare', fixed.HELPER_FUNCTION)} OR {_hit('bare', fixed.HELPER_ARROW)} OR {_hit('bare', fixed.SCREENPLAY)})",
    "uses_page_object": _PAGE_OBJECT,
    "uses_fixtures": _hit("bare", fixed.FIXTURES),
    "uses_polling": _hit("bare", fixed.POLLING),
    "uses_network": _hit("bare", fixed.NETWORK),
    "uses_api": _hit("bare", fixed.API),
    "uses_download": _hit("no_comments", fixed.DOWNLOAD),
    "uses_accessibility": _hit("bare", fixed.ACCESSIBILITY),
    "uses_performance": _hit("bare", fixed.PERFORMANCE),
    "uses_realtime": _hit("bare", fixed.REALTIME),
}


def _detector(name: str, spark, sf_dir) -> DataFrame:
    scans = _scans(spark, sf_dir)
    flag = detectors.pattern_flags(F.col("_code"), F.col("_bare"))[name]
    return scans.select("doc_id", flag.alias(name))


for _name, _sql in _DETECTOR_SQL.items():
    _query = f"detect_{_name.removeprefix('uses_')}"
    QUERIES[_query] = partial(_detector, _name)
    SQL[_query] = _over_scans(f"SELECT doc_id, {_sql} AS {_name} FROM scans")

_STRENGTH = f"""CASE WHEN expected_pattern IS NULL THEN NULL WHEN NOT attempted THEN 0.0::DOUBLE
  WHEN expected_pattern = 'polling' THEN CASE WHEN {_hit('bare', fixed.POLLING_PROPER)} THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END
  WHEN expected_pattern = 'fixtures' THEN CASE WHEN {_hit('bare', fixed.FIXTURES_STRONG)} THEN 1.0::DOUBLE
    WHEN {_hit('bare', fixed.FIXTURES_HOOK)} THEN 0.5::DOUBLE WHEN {_hit('bare', fixed.FIXTURES_STATE)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END
  ELSE 1.0::DOUBLE END"""
_FLAGS = ", ".join(f"{sql} AS {name}" for name, sql in _DETECTOR_SQL.items())
_ATTEMPTED = (
    "CASE expected_pattern "
    + " ".join(f"WHEN '{n.removeprefix('uses_')}' THEN {n}" for n in _DETECTOR_SQL)
    + " ELSE false END"
)


def pattern_credit(spark, sf_dir):
    """All technique flags with graded credit for the expected one."""
    scans = text_features.with_patterns(_scans(spark, sf_dir))
    return text_features.drop_scans(scans).drop("code")


SQL["pattern_credit"] = _over_scans(
    f""", flagged AS (SELECT *, {_FLAGS} FROM scans),
        tried AS (SELECT *, {_ATTEMPTED} AS attempted FROM flagged)
        SELECT doc_id, expected_pattern, {", ".join(_DETECTOR_SQL)}, attempted AS pattern_attempted, {_STRENGTH} AS pattern_used FROM tried"""
)

# --- Craft ----------------------------------------------------------------------

_TIER_PATTERNS = [p for p, _ in fixed.LOCATOR_TIERS]
_WEIGHTED = " + ".join(f"n{i} * {w}::DOUBLE" for i, (_, w) in enumerate(fixed.LOCATOR_TIERS))
_CRAFT_SQL = {
    "locator_quality": f"""(0.0::DOUBLE + {_WEIGHTED} + (greatest(0, css - brittle) * 0.4::DOUBLE + brittle * 0.1::DOUBLE))
        / nullif(n0 + n1 + n2 + n3 + greatest(0, css - brittle) + brittle, 0)""",
    "assertion_quality": "good / nullif(good + manual, 0)",
    "waiting_quality": """CASE WHEN good_wait AND NOT bad_wait THEN 1.0::DOUBLE WHEN good_wait AND bad_wait THEN 0.5::DOUBLE
        WHEN bad_wait THEN 0.0::DOUBLE END""",
    "uses_arbitrary_timeout": "bad_wait",
    "teardown_hygiene": f"""CASE WHEN {_hit('bare', fixed.NEEDS_TEARDOWN)} THEN
        CASE WHEN {_hit('bare', fixed.HAS_TEARDOWN)} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END""",
    "uses_unique_data": f"{_hit('bare', fixed.UNIQUE_DATA)} OR {_hit('bare', fixed.LENGTH_DELTA)}",
    "uses_hardcoded_url": _hit("no_comments", fixed.HARDCODED_URL),
    "uses_fragile_selector": "brittle > 0",
    "has_code_smell": " OR ".join(["brittle > 0", *(_hit("bare", p) for p in fixed.SMELLS)]),
    "dry_score": """CASE WHEN len(stmts) >= 4 THEN 1.0::DOUBLE - (len(stmts) - len(list_distinct(stmts))) / len(stmts) END""",
}
_STATEMENTS = (
    r"list_transform(regexp_extract_all(no_comments, '(?m)^\s*(await\s+.+|expect\s*\(.+)$', 1), "
    rf"lambda s: {_trim(r"regexp_replace(s, '\s+', ' ', 'g')")})"
)
_COUNTS = (
    ", ".join(f"{_count('no_comments', p)} AS n{i}" for i, p in enumerate(_TIER_PATTERNS))
    + f", {_count('no_comments', fixed.CSS_LOCATOR)} AS css, {_count('no_comments', fixed.BRITTLE_SELECTOR)} AS brittle, "
    f"{_count('bare', fixed.WEB_FIRST_ASSERT)} AS good, {_count('bare', fixed.MANUAL_ASSERT)} AS manual, "
    f"{_hit('bare', fixed.GOOD_WAIT)} AS good_wait, {_hit('bare', fixed.ARBITRARY_WAIT)} AS bad_wait, {_STATEMENTS} AS stmts"
)


def _craft(names, spark, sf_dir) -> DataFrame:
    return text_features.with_craft(_scans(spark, sf_dir)).select("doc_id", *names)


def _craft_sql(names) -> str:
    chosen = ", ".join(f"{_CRAFT_SQL[n]} AS {n}" for n in names)
    return _over_scans(f", counted AS (SELECT *, {_COUNTS} FROM scans) SELECT doc_id, {chosen} FROM counted")


for _query, _names in {
    "craft_locator_quality": ("locator_quality",),
    "craft_assertion_quality": ("assertion_quality",),
    "craft_waiting_quality": ("waiting_quality", "uses_arbitrary_timeout"),
    "craft_teardown_hygiene": ("teardown_hygiene",),
    "craft_unique_data": ("uses_unique_data",),
    "craft_hardcoded_url": ("uses_hardcoded_url",),
    "craft_smells": ("uses_fragile_selector", "has_code_smell"),
    "craft_dry_score": ("dry_score",),
    "craft_all": tuple(_CRAFT_SQL),
}.items():
    QUERIES[_query] = partial(_craft, _names)
    SQL[_query] = _craft_sql(_names)


def text_job(spark, sf_dir):
    """The whole text job over every model output: parse, detect, grade."""
    texts = bindings.model_texts(spark, sf_dir)
    code = parsing.code_block(F.col("raw_output"), _TYPESCRIPT)
    return text_features.e2e_features(texts.withColumn("parsed", code)).drop("raw_output", "parsed")


SQL["text_job"] = _over_scans(
    f""", counted AS (SELECT *, {_COUNTS}, {_FLAGS} FROM scans), tried AS (SELECT *, {_ATTEMPTED} AS attempted FROM counted)
        SELECT doc_id, expected_pattern, {", ".join(_DETECTOR_SQL)}, attempted AS pattern_attempted, {_STRENGTH} AS pattern_used,
          {", ".join(f"{sql} AS {n}" for n, sql in _CRAFT_SQL.items())},
          {_hit('no_comments', fixed.ROBUST_SELECTOR)} AND brittle = 0 AS selectors_robust FROM tried"""
)

# --- JSON out of replies --------------------------------------------------------


def json_objects(spark, sf_dir):
    """Fields of the JSON object in each localization reply, fenced or inline."""
    given = bindings.localization_replies(spark, sf_dir)
    document = parsing.with_json_object(given, "reply", "document")
    return document.select(
        "sample_id",
        F.get_json_object("document", "$.line").alias("line"),
        F.get_json_object("document", "$.start_line").alias("start_line"),
        F.get_json_object("document", "$.end_line").alias("end_line"),
        F.get_json_object("document", "$.proposed_fix").alias("proposed_fix"),
    )


_LINE = "CAST(line_given AS VARCHAR)"
SQL["json_objects"] = with_bindings(
    "localization",
    f"""SELECT sample_id,
          CASE shape WHEN 2 THEN {_LINE} WHEN 3 THEN {_LINE} || '.0' WHEN 6 THEN {_LINE} END AS line,
          CASE shape WHEN 0 THEN {_LINE} WHEN 1 THEN CAST(wide_given AS VARCHAR) WHEN 4 THEN 'true' END AS start_line,
          CASE shape WHEN 0 THEN CAST(wide_given AS VARCHAR) WHEN 1 THEN {_LINE} WHEN 5 THEN {_LINE} END AS end_line,
          'done(1)' AS proposed_fix
        FROM v_localization""",
)


def judge_objects(spark, sf_dir):
    """Validity and fields of judge replies; trailing braces make a reply invalid."""
    given = bindings.replies(spark, sf_dir)
    document = parsing.with_judge_json(given, "reply", "document")
    return document.select(
        "doc_id",
        (F.col("document") != "{}").alias("valid"),
        F.get_json_object("document", "$.rationale").alias("rationale"),
    )


SQL["judge_objects"] = with_bindings(
    "replies",
    "SELECT doc_id, valid, CASE WHEN valid THEN text END AS rationale FROM v_replies",
)

# --- Localization ---------------------------------------------------------------


def _localized(spark, sf_dir) -> DataFrame:
    given = bindings.localization_replies(spark, sf_dir)
    given = parsing.with_json_object(given, "reply", "document")
    spans = localize.with_span(given, "document")
    return localize.with_hits(spans, F.col("payload.fault_lines"))


_SPAN = """
WITH spans AS (SELECT *,
    CASE shape WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 0 THEN least(line_given, wide_given) WHEN 1 THEN least(line_given, wide_given) ELSE line_given END AS first_line,
    CASE shape WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 0 THEN greatest(line_given, wide_given) WHEN 1 THEN greatest(line_given, wide_given) ELSE line_given END AS last_line
  FROM v_localization)"""


def predicted_span(spark, sf_dir):
    """First and last predicted line of each reply, -1 without a prediction."""
    return _localized(spark, sf_dir).select("sample_id", "predicted_line", "predicted_end_line")


SQL["predicted_span"] = with_bindings(
    "localization",
    f"""{_SPAN} SELECT sample_id, CAST(coalesce(first_line, -1) AS BIGINT) AS predicted_line,
          CAST(coalesce(last_line, -1) AS BIGINT) AS predicted_end_line FROM spans""",
)


def localization_hits(spark, sf_dir):
    """Exact and near hits of each reply."""
    return _localized(spark, sf_dir).select("sample_id", "localized", "localized_within_1")


SQL["localization_hits"] = with_bindings(
    "localization",
    f"""{_SPAN} SELECT sample_id, coalesce(p_size BETWEEN first_line AND last_line, false) AS localized,
          coalesce(p_size BETWEEN first_line - 1 AND last_line + 1, false) AS localized_within_1 FROM spans""",
)


def patch_sources(spark, sf_dir):
    """Patched source of each reply that names a valid span and a fix."""
    return localize.with_patch(_localized(spark, sf_dir), "document").select("sample_id", "patched")


SQL["patch_sources"] = with_bindings(
    "localization",
    f"""{_SPAN}, lined AS (SELECT *, string_split(source, chr(10)) AS lines FROM spans)
        SELECT sample_id, CASE WHEN test IS NOT NULL AND first_line >= 1 AND last_line <= len(lines) THEN
          array_to_string(list_concat(lines[1:first_line - 1],
            [CASE WHEN first_line = last_line THEN '    done(1)' ELSE 'done(1)' END], lines[last_line + 1:]), chr(10)) || chr(10) END AS patched
        FROM lined""",
)


def numbered_listing(spark, sf_dir):
    """Source of every sample with right-aligned line numbers."""
    return bindings.samples(spark, sf_dir).select(
        "sample_id", localization.numbered_listing(F.col("payload.source")).alias("listing")
    )


SQL["numbered_listing"] = with_bindings(
    "samples",
    """SELECT sample_id, array_to_string(list_transform(string_split(source, chr(10)),
         lambda line, i: lpad(CAST(i AS VARCHAR), CAST(greatest(3, len(CAST(i AS VARCHAR))) AS INTEGER), ' ') || '  ' || line), chr(10)) AS listing
       FROM v_samples""",
)

for _fn in (
    extract_code_block, strip_comments_text, strip_noise_text, page_lexing, static_tests,
    python_syntax, selector_robustness, pattern_credit, text_job, json_objects, judge_objects,
    predicted_span, localization_hits, patch_sources, numbered_listing,
):
    QUERIES[_fn.__name__] = _fn
