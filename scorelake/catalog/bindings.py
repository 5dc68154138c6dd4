"""Evaluation tables derived from the supplied star-schema tables.

The supplied data holds no evaluation runs, so every input of an operator is a
deterministic projection of a supplied table: it has as many rows as that table.
Numbers are small integers over powers of two, so sums are exact in any order.
``SQL`` holds the same definitions for the checking engine.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake import schemas
TECHNIQUES = fixed.PATTERN_TECHNIQUES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def heavy_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table for work that is heavy per row, dealt into even partitions by one exchange.

    Files may hold their rows in few large row groups, which a scan cannot split. The
    partitions' number follows from the bytes found, so the plan is the same at every size.
    """
    return table(spark, sf_dir, name).hint("rebalance")


def _track(key: str) -> Column:
    tracks = F.array(*(F.lit(t) for t in fixed.TRACK_NAMES))
    return F.get(tracks, (F.col(key) % 6).cast("int"))


_TRACK_ARRAY = "array(" + ", ".join(f"'{t}'" for t in fixed.TRACK_NAMES) + ")"

# The four key columns of a line item, as Spark SQL expressions.
_TASK_KEY = (
    "concat('m', lpad(cast(l_suppkey % 20 AS string), 2, '0')) AS model_slug",
    f"{_TRACK_ARRAY}[cast(l_orderkey % 6 AS int)] AS track",
    "concat('s', l_partkey % 50) AS sample_id",
    "cast((l_linenumber - 1) % 3 AS int) AS trial",
)

_UNIT, _BUG, _DESIGN = (
    f"track = '{t}'" for t in ("unit_test_gen", "bug_localization", "test_case_design")
)
_E2E = "startswith(track, 'e2e')"
_KILLED = f"if({_UNIT} AND l_linenumber <> 7, cast((l_partkey + l_suppkey) % 5 AS int), NULL)"

# Scored columns: name, rows that have it, value.
_SCORED_COLUMNS = (
    ("attempts", None, "cast(1 + (l_partkey + l_linenumber) % 3 AS int)"),
    ("tokens_in", None, "cast(l_quantity * 5 AS bigint) + l_linenumber"),
    ("tokens_out", None, "cast(l_quantity * 10 AS bigint)"),
    ("latency_s", None, "(l_quantity + l_linenumber) / 8"),
    ("cost", None, "l_quantity / 1024"),
    ("passed", None, f"if({_DESIGN}, l_linenumber >= 4, (l_partkey + l_suppkey) % 3 <> 0)"),
    ("tests_total", _UNIT, "10"),
    ("tests_failing_on_correct", _UNIT, "cast(l_partkey % 3 AS int)"),
    ("mutants_total", _UNIT, "4"),
    ("mutants_killed", None, _KILLED),
    ("mutants_surviving", _UNIT, f"4 - coalesce({_KILLED}, 0)"),
    ("coverage_pct", _UNIT, "l_quantity * 2"),
    ("runs_and_valid", _UNIT, "l_partkey % 3 = 0"),
    ("design_judge", f"{_UNIT} OR {_DESIGN}", "l_linenumber / 8"),
    ("hallucinated", _UNIT, "l_partkey % 7 = 0"),
    ("localized", _BUG, "l_suppkey % 4 <> 0"),
    ("repair_passed", _BUG, "l_suppkey % 2 = 0"),
    ("e2e_ran", _E2E, "l_linenumber <> 7"),
    ("pattern_used", _E2E, "(l_linenumber % 3) / 2"),
    ("locator_quality", _E2E, "(l_partkey % 9) / 8"),
    ("assertion_quality", _E2E, "(l_suppkey % 5) / 4"),
    ("waiting_quality", _E2E, "(l_linenumber % 3) / 2"),
    ("teardown_hygiene", f"{_E2E} AND l_partkey % 4 = 0", "cast(l_linenumber % 2 AS double)"),
    ("uses_hardcoded_url", _E2E, "l_partkey % 11 = 0"),
    ("has_code_smell", _E2E, "l_partkey % 6 = 0"),
    ("uses_network", _E2E, "l_partkey % 2 = 0"),
    ("uses_polling", _E2E, "l_partkey % 3 = 0"),
    ("uses_api", _E2E, "l_partkey % 5 = 0"),
    ("review_score", _E2E, "l_linenumber / 8"),
    ("dry_score", _E2E, "(l_partkey % 5) / 4"),
)


# Arrival order of a line item, unique up to identical rows.
_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag")
ARRIVAL = f"struct({', '.join(_ORDER)}) AS arrival"
_ARRIVAL_SQL = f"struct_pack({', '.join(f'{c} := {c}' for c in _ORDER)}) AS arrival"


def scored(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Scored rows, one per line item, with extra line-item columns where asked for."""
    columns = (
        f"{value} AS {name}" if rows is None else f"if({rows}, {value}, NULL) AS {name}"
        for name, rows, value in _SCORED_COLUMNS
    )
    keyed = table(spark, sf_dir, "lineitem").selectExpr(*_TASK_KEY, "*")
    return keyed.selectExpr("model_slug", "track", "sample_id", "trial", *columns, *extra)


_SCORED_SQL = """
lineitem_keyed AS (
  SELECT *, 'm' || lpad(CAST(l_suppkey % 20 AS VARCHAR), 2, '0') AS model_slug,
    (['unit_test_gen','bug_localization','test_case_design','e2e_ui','e2e_advanced','e2e_repair'])[l_orderkey % 6 + 1] AS track,
    's' || CAST(l_partkey % 50 AS VARCHAR) AS sample_id,
    CAST((l_linenumber - 1) % 3 AS INTEGER) AS trial
  FROM lineitem
),
v_scored AS (
  SELECT model_slug, track, sample_id, trial,
    CAST(1 + (l_partkey + l_linenumber) % 3 AS INTEGER) AS attempts,
    CAST(l_quantity * 5 AS BIGINT) + l_linenumber AS tokens_in,
    CAST(l_quantity * 10 AS BIGINT) AS tokens_out,
    (l_quantity + l_linenumber) / 8 AS latency_s,
    l_quantity / 1024 AS cost,
    CASE WHEN track = 'test_case_design' THEN l_linenumber >= 4 ELSE (l_partkey + l_suppkey) % 3 <> 0 END AS passed,
    CASE WHEN track = 'unit_test_gen' THEN 10 END AS tests_total,
    CASE WHEN track = 'unit_test_gen' THEN CAST(l_partkey % 3 AS INTEGER) END AS tests_failing_on_correct,
    CASE WHEN track = 'unit_test_gen' THEN 4 END AS mutants_total,
    CASE WHEN track = 'unit_test_gen' AND l_linenumber <> 7 THEN CAST((l_partkey + l_suppkey) % 5 AS INTEGER) END AS mutants_killed,
    CASE WHEN track = 'unit_test_gen' THEN 4 - CASE WHEN l_linenumber <> 7 THEN CAST((l_partkey + l_suppkey) % 5 AS INTEGER) ELSE 0 END END AS mutants_surviving,
    CASE WHEN track = 'unit_test_gen' THEN l_quantity * 2 END AS coverage_pct,
    CASE WHEN track = 'unit_test_gen' THEN l_partkey % 3 = 0 END AS runs_and_valid,
    CASE WHEN track IN ('unit_test_gen','test_case_design') THEN l_linenumber / 8.0::DOUBLE END AS design_judge,
    CASE WHEN track = 'unit_test_gen' THEN l_partkey % 7 = 0 END AS hallucinated,
    CASE WHEN track = 'bug_localization' THEN l_suppkey % 4 <> 0 END AS localized,
    CASE WHEN track = 'bug_localization' THEN l_suppkey % 2 = 0 END AS repair_passed,
    CASE WHEN track LIKE 'e2e%' THEN l_linenumber <> 7 END AS e2e_ran,
    CASE WHEN track LIKE 'e2e%' THEN (l_linenumber % 3) / 2.0::DOUBLE END AS pattern_used,
    CASE WHEN track LIKE 'e2e%' THEN (l_partkey % 9) / 8.0::DOUBLE END AS locator_quality,
    CASE WHEN track LIKE 'e2e%' THEN (l_suppkey % 5) / 4.0::DOUBLE END AS assertion_quality,
    CASE WHEN track LIKE 'e2e%' THEN (l_linenumber % 3) / 2.0::DOUBLE END AS waiting_quality,
    CASE WHEN track LIKE 'e2e%' AND l_partkey % 4 = 0 THEN CAST(l_linenumber % 2 AS DOUBLE) END AS teardown_hygiene,
    CASE WHEN track LIKE 'e2e%' THEN l_partkey % 11 = 0 END AS uses_hardcoded_url,
    CASE WHEN track LIKE 'e2e%' THEN l_partkey % 6 = 0 END AS has_code_smell,
    CASE WHEN track LIKE 'e2e%' THEN l_partkey % 2 = 0 END AS uses_network,
    CASE WHEN track LIKE 'e2e%' THEN l_partkey % 3 = 0 END AS uses_polling,
    CASE WHEN track LIKE 'e2e%' THEN l_partkey % 5 = 0 END AS uses_api,
    CASE WHEN track LIKE 'e2e%' THEN l_linenumber / 8.0::DOUBLE END AS review_score,
    CASE WHEN track LIKE 'e2e%' THEN (l_partkey % 5) / 4.0::DOUBLE END AS dry_score
  FROM lineitem_keyed
)"""


# Code lines by the prime that selects them.
_LINES = (
    (2, "await page.getByRole('button', { name: 'go' }).click();"),
    (3, "await page.goto('http://localhost:5173/ledger'); // earlier tr:nth-child(6)"),
    (5, "await page.locator('li:nth-child(2)').click();"),
    (7, "await expect(page.getByTestId('balance')).toHaveText('42.00');"),
    (11, "await expect.poll(() => ledger.size()).toBe(4);"),
    (13, "await page.waitForTimeout(750);"),
    (17, "class LedgerPage { constructor(page) { this.page = page; } }"),
    (19, "await page.route('**/ledger/*.json', call => call.fulfill({ json: [] }));"),
    (23, "const sheet = await page.waitForEvent('download');"),
    (29, "/* request.post would do */ test.beforeAll(async () => { await seed(); });"),
    (31, "const made = await request.put('/api/notes/' + Date.now(), { data: {} });"),
    (37, "const found = await new AxeBuilder({ page }).include('#main').analyze();"),
    (41, "const paints = await page.evaluate(() => performance.getEntriesByType('paint'));"),
    (43, "await page.routeWebSocket('/live', socket => socket.close());"),
    (47, "async function openNote(page, title) { await page.keyboard.press('n'); }"),
    (53, "const addNote = async (page, body) => page.keyboard.type(body);"),
    (59, "await reader.attemptsTo(Open.the('notes'));"),
    (61, "test.use({ storageState: 'reader.json' });"),
    (67, "const test = base.extend({ notes: async ({ page }, use) => use([]) });"),
    (71, "expect(await page.title()).toBe('notes'); test.beforeEach(async () => {});"),
    (73, "test.afterAll(async () => { await context.clearCookies(); });"),
    (79, "const text = await page.evaluate(() => document.body.innerHTML);"),
    (83, "await page.reload();\nawait page.reload();\nawait page.reload();\nawait page.goBack();"),
    (89, "const n = await page.$$('li'); expect(await page.locator('a').isVisible()).toBe(true);"),
)


def snippet(number: Column, label: Column) -> Column:
    """Test code with one line per listed prime that divides the number."""
    first = F.concat(F.lit('const tag = "http://x/'), label, F.lit('"; // tag'))
    lines = [F.when(number % p == 0, F.lit(text)) for p, text in _LINES]
    return F.concat_ws("\n", first, *lines)


def fenced(number: Column, body: Column) -> Column:
    """The code inside a fence that varies with the number; some are never closed."""
    kind = number % 4
    opening = (
        F.when(kind == 0, F.lit("```ts\n"))
        .when(kind == 1, F.lit("```typescript\n"))
        .when(kind == 2, F.lit("```\n"))
        .otherwise(F.lit(""))
    )
    closing = F.when((kind == 3) | (number % 10 == 2), F.lit("")).otherwise(F.lit("\n```"))
    return F.concat(opening, body, closing)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _snippet_sql(number: str, label: str) -> str:
    lines = ", ".join(
        f"CASE WHEN {number} % {p} = 0 THEN {_quoted(text)} END" for p, text in _LINES
    )
    return f"concat_ws(chr(10), 'const tag = \"http://x/' || {label} || '\"; // tag', {lines})"


def _fenced_sql(number: str, body: str) -> str:
    return (
        f"CASE {number} % 4 WHEN 0 THEN '```ts' || chr(10) WHEN 1 THEN '```typescript' || chr(10) "
        f"WHEN 2 THEN '```' || chr(10) ELSE '' END || {body} || "
        f"CASE WHEN {number} % 4 = 3 OR {number} % 10 = 2 THEN '' ELSE chr(10) || '```' END"
    )


def model_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw model output per document: prose, then fenced code with the text as a comment or as code."""
    doc_id, text = F.col("doc_id"), F.col("text")
    shown = F.when(doc_id % 2 == 0, F.concat(F.lit("/* "), text, F.lit(" */"))).otherwise(text)
    body = F.concat(snippet(doc_id, F.col("lang")), F.lit("\n"), shown)
    names = F.array(*(F.lit(t) for t in TECHNIQUES))
    return heavy_table(spark, sf_dir, "documents").select(
        "doc_id",
        F.concat(F.lit("Notes:\n"), text, F.lit("\n"), fenced(doc_id, body)).alias("raw_output"),
        F.get(names, (doc_id % 10).cast("int")).alias("expected_pattern"),
    )


_TEXTS_SQL = (
    """
v_texts AS (
  SELECT doc_id, 'Notes:' || chr(10) || text || chr(10) || """
    + _fenced_sql(
        "doc_id", "(" + _snippet_sql("doc_id", "lang") + " || chr(10) || CASE WHEN doc_id % 2 = 0 THEN '/* ' || text || ' */' ELSE text END)"
    )
    + """ AS raw_output,
    (["""
    + ", ".join(_quoted(t) for t in TECHNIQUES)
    + """])[doc_id % 10 + 1] AS expected_pattern
  FROM documents
)"""
)


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Response rows, one per line item; keys repeat. ``ingest_seq`` is arrival order."""
    part = F.col("l_partkey")
    raw = fenced(part, snippet(part, F.col("l_returnflag")))
    keyed = table(spark, sf_dir, "lineitem").selectExpr(*_TASK_KEY, "*")
    return keyed.withColumn("raw", raw).selectExpr(
        "model_slug",
        "if(l_suppkey % 5 = 0, 'local', 'openrouter') AS provider",
        "track",
        "sample_id",
        "if(l_linenumber <> 6, trial, NULL) AS trial",
        "cast((l_partkey + l_linenumber) % 4 AS int) AS attempts",
        "left(sha2(track, 256), 12) AS prompt_hash",
        "cast(l_quantity * 5 AS bigint) + l_linenumber AS tokens_in",
        "cast(l_quantity * 10 AS bigint) AS tokens_out",
        "(l_quantity + l_linenumber) / 8 AS latency_s",
        "l_quantity / 1024 AS cost",
        "if(l_partkey % 17 = 0, 'TimeoutError: slow', '') AS error",
        "if(l_partkey % 17 <> 0, raw, NULL) AS raw_output",
        "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag) AS ingest_seq",
    )


_RESPONSES_SQL = (
    """
v_responses AS (
  SELECT model_slug, CASE WHEN l_suppkey % 5 = 0 THEN 'local' ELSE 'openrouter' END AS provider,
    track, sample_id, CASE WHEN l_linenumber <> 6 THEN trial END AS trial,
    CAST((l_partkey + l_linenumber) % 4 AS INTEGER) AS attempts,
    left(sha256(track), 12) AS prompt_hash,
    CAST(l_quantity * 5 AS BIGINT) + l_linenumber AS tokens_in,
    CAST(l_quantity * 10 AS BIGINT) AS tokens_out,
    (l_quantity + l_linenumber) / 8 AS latency_s, l_quantity / 1024 AS cost,
    CASE WHEN l_partkey % 17 = 0 THEN 'TimeoutError: slow' ELSE '' END AS error,
    CASE WHEN l_partkey % 17 <> 0 THEN """
    + _fenced_sql("l_partkey", "(" + _snippet_sql("l_partkey", "l_returnflag") + ")")
    + """ END AS raw_output,
    struct_pack(l_orderkey := l_orderkey, l_linenumber := l_linenumber, l_partkey := l_partkey, l_suppkey := l_suppkey,
      l_quantity := l_quantity, l_returnflag := l_returnflag) AS ingest_seq
  FROM lineitem_keyed
)"""
)


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model registry with one entry per supplier."""
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("m"), key.cast("string")).alias("slug"),
        F.col("s_name").alias("id"),
        F.when(key % 5 == 0, "local").otherwise("openrouter").alias("provider"),
        F.when(key % 3 == 0, "").otherwise(F.col("s_name")).alias("label"),
        ((nation + 1) / 4).alias("input_cost_per_mtok"),
        ((nation + 1) / 2).alias("output_cost_per_mtok"),
        (key % 3 == 0).alias("skip_by_default"),
    )


_MODELS_SQL = """
v_models AS (
  SELECT 'm' || CAST(s_suppkey AS VARCHAR) AS slug, s_name AS id,
    CASE WHEN s_suppkey % 5 = 0 THEN 'local' ELSE 'openrouter' END AS provider,
    CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE s_name END AS label,
    (s_nationkey + 1) / 4.0::DOUBLE AS input_cost_per_mtok,
    (s_nationkey + 1) / 2.0::DOUBLE AS output_cost_per_mtok,
    s_suppkey % 3 = 0 AS skip_by_default
  FROM supplier
)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples, one per part: numbered filler source, fault lines, scenario texts."""
    key, size = F.col("p_partkey"), F.col("p_size")
    numbers = F.sequence(F.lit(1), size + 2)
    source = F.array_join(
        F.transform(
            numbers,
            lambda n: F.concat(F.lit("    step("), n.cast("string"), F.lit(", '"), F.col("p_brand"), F.lit("')")),
        ),
        "\n",
    )
    names = F.array(*(F.lit(t) for t in TECHNIQUES))
    payload = {
        "source": source,
        "module_name": F.concat(F.lit("mod"), key.cast("string")),
        "mutants": F.array(F.col("p_name"), F.col("p_type")),
        "fault_lines": F.array(size.cast("int")),
        "symptom": F.col("p_type"),
        "test": F.when(key % 4 != 0, F.lit("def test_it(): pass")),
        "requirement": F.col("p_name"),
        "flow": F.concat(F.lit("Open "), F.col("p_name")),
        "base_url": F.lit("http://localhost:8081"),
        "success": F.col("p_brand"),
        "expected_pattern": F.get(names, (key % 10).cast("int")),
        "broken_test": F.concat(F.lit("await page.goto('/"), F.col("p_brand"), F.lit("');")),
        "error": F.concat(F.lit("Timeout in "), F.col("p_type")),
    }
    fields = [
        payload[f.name].alias(f.name)
        if f.name in payload
        else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schemas.PAYLOAD.fields
    ]
    return table(spark, sf_dir, "part").select(
        _track("p_partkey").alias("track"),
        F.concat(F.lit("p"), key.cast("string")).alias("sample_id"),
        F.struct(*fields).alias("payload"),
    )


_SAMPLES_SQL = (
    """
v_samples AS (
  SELECT (['unit_test_gen','bug_localization','test_case_design','e2e_ui','e2e_advanced','e2e_repair'])[p_partkey % 6 + 1] AS track,
    'p' || CAST(p_partkey AS VARCHAR) AS sample_id, p_partkey, p_size,
    array_to_string(list_transform(range(1, p_size + 3), lambda n: '    step(' || CAST(n AS VARCHAR) || ', ''' || p_brand || ''')'), chr(10)) AS source,
    'mod' || CAST(p_partkey AS VARCHAR) AS module_name,
    [p_name, p_type] AS mutants,
    [p_size] AS fault_lines, p_type AS symptom,
    CASE WHEN p_partkey % 4 <> 0 THEN 'def test_it(): pass' END AS test,
    p_name AS requirement, 'Open ' || p_name AS flow, 'http://localhost:8081' AS base_url,
    p_brand AS success,
    (["""
    + ", ".join(_quoted(t) for t in TECHNIQUES)
    + """])[p_partkey % 10 + 1] AS expected_pattern,
    'await page.goto(''/' || p_brand || ''');' AS broken_test, 'Timeout in ' || p_type AS error
  FROM part
)"""
)


def localization_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bug-localization replies, one per part, in all the accepted span shapes."""
    key, size = F.col("p_partkey"), F.col("p_size")
    line = size + (key % 3).cast("int") - 1
    shown = line.cast("string")
    wide = (size + 1).cast("string")
    fix = F.lit('"proposed_fix": "done(1)"')
    body = (
        F.when(key % 7 == 0, F.concat(F.lit('"start_line": '), shown, F.lit(', "end_line": '), wide))
        .when(key % 7 == 1, F.concat(F.lit('"start_line": '), wide, F.lit(', "end_line": '), shown))
        .when(key % 7 == 2, F.concat(F.lit('"line": "'), shown, F.lit('"')))
        .when(key % 7 == 3, F.concat(F.lit('"line": '), shown, F.lit(".0")))
        .when(key % 7 == 4, F.lit('"start_line": true, "end_line": null'))
        .when(key % 7 == 5, F.concat(F.lit('"end_line": '), shown))
        .otherwise(F.concat(F.lit('"line": '), shown))
    )
    document = F.concat(F.lit("{"), body, F.lit(", "), fix, F.lit("}"))
    reply = F.when(key % 5 == 0, F.concat(F.lit("Found it: "), document)).otherwise(
        F.concat(F.lit("Look:\n```json\n"), document, F.lit("\n```\nok"))
    )
    return samples(spark, sf_dir).join(
        table(spark, sf_dir, "part").select(
            F.concat(F.lit("p"), key.cast("string")).alias("sample_id"), reply.alias("reply")
        ),
        "sample_id",
    )


_LOCALIZATION_SQL = """
v_localization AS (
  SELECT *, p_size + p_partkey % 3 - 1 AS line_given, p_size + 1 AS wide_given, p_partkey % 7 AS shape
  FROM v_samples
)"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat messages in long form."""
    return table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )


def exec_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Execution logs, one per event."""
    key = F.col("event_id")
    number = lambda c: c.cast("string")
    blob = F.concat(
        F.lit('{"tests_total": '), number(key % 6),
        F.lit(', "tests_passed": '), number(key % 3),
        F.lit(', "tests_failing_on_correct": '), number(key % 2),
        F.lit(', "collection_ok": '), F.when(key % 5 != 0, "true").otherwise("false"),
        F.lit(', "coverage_pct": '), F.when(key % 7 == 0, "null").otherwise(number(key % 100)),
        F.lit(', "mutants_total": 4, "mutants_killed": '), number(key % 5), F.lit("}"),
    )
    stdout = (
        F.when(key % 11 == 0, F.concat(F.lit("no result "), F.col("props")))
        .when(key % 13 == 0, F.lit(f"log\n{fixed.RESULT_MARKER}\nnot json"))
        .otherwise(F.concat(F.lit(f"collected\n{fixed.RESULT_MARKER}\n"), blob, F.lit("\nbye")))
    )
    tally = F.concat(
        number(key % 9), F.lit(" passed, "), number(key % 4), F.lit(" failed, "),
        number(key % 3), F.lit(" errors in 0.1s"),
    )
    return table(spark, sf_dir, "events").select(
        "event_id",
        (key % 3).cast("int").alias("exit_code"),
        (F.col("event_type") == "error").alias("timed_out"),
        stdout.alias("stdout"),
        F.when(key % 2 == 0, F.concat(F.lit("trace "), F.col("props"))).otherwise("").alias("stderr"),
        tally.alias("tally"),
        F.when(key % 4 == 0, 429)
        .when(key % 4 == 1, 503)
        .when(key % 4 == 2, 400)
        .cast("int")
        .alias("status"),
        F.when(key % 8 == 3, "ConnectError: boom").otherwise("").alias("error"),
    )


_EXEC_SQL = f"""
v_exec AS (
  SELECT event_id, CAST(event_id % 3 AS INTEGER) AS exit_code, event_type = 'error' AS timed_out,
    CASE WHEN event_id % 11 = 0 THEN 'no result ' || props
      WHEN event_id % 13 = 0 THEN 'log' || chr(10) || '{fixed.RESULT_MARKER}' || chr(10) || 'not json'
      ELSE 'collected' || chr(10) || '{fixed.RESULT_MARKER}' || chr(10) || '{{"tests_total": ' || (event_id % 6) || ', "tests_passed": ' || (event_id % 3)
        || ', "tests_failing_on_correct": ' || (event_id % 2) || ', "collection_ok": ' || CASE WHEN event_id % 5 <> 0 THEN 'true' ELSE 'false' END
        || ', "coverage_pct": ' || CASE WHEN event_id % 7 = 0 THEN 'null' ELSE CAST(event_id % 100 AS VARCHAR) END
        || ', "mutants_total": 4, "mutants_killed": ' || (event_id % 5) || '}}' || chr(10) || 'bye' END AS stdout,
    CASE WHEN event_id % 2 = 0 THEN 'trace ' || props ELSE '' END AS stderr,
    (event_id % 9) || ' passed, ' || (event_id % 4) || ' failed, ' || (event_id % 3) || ' errors in 0.1s' AS tally,
    CASE event_id % 4 WHEN 0 THEN 429 WHEN 1 THEN 503 WHEN 2 THEN 400 END AS status,
    CASE WHEN event_id % 8 = 3 THEN 'ConnectError: boom' ELSE '' END AS error
  FROM events
)"""


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generation attempts, one per event, four to a task."""
    key = F.col("event_id")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("m"), (F.floor(key / 4) % 20).cast("string")).alias("model_slug"),
        F.lit("unit_test_gen").alias("track"),
        F.concat(F.lit("t"), F.floor(key / 4).cast("string")).alias("sample_id"),
        F.lit(0).alias("trial"),
        (key % 4 + 1).cast("int").alias("attempt"),
        (1 + key % 64).alias("tokens_in"),
        (1 + key % 32).alias("tokens_out"),
        ((key % 16) / 8).alias("latency_s"),
        ((key % 64) / 1024).alias("cost"),
        (F.col("event_type") == "purchase").alias("passed"),
        F.when(F.col("event_type") == "error", "TimeoutError: slow").otherwise("").alias("error"),
        F.col("props").alias("raw_output"),
        F.concat(F.lit("fix "), F.col("event_type")).alias("feedback"),
    )


_ATTEMPTS_SQL = """
v_attempts AS (
  SELECT 'm' || CAST((event_id // 4) % 20 AS VARCHAR) AS model_slug, 'unit_test_gen' AS track,
    't' || CAST(event_id // 4 AS VARCHAR) AS sample_id, 0 AS trial, CAST(event_id % 4 + 1 AS INTEGER) AS attempt,
    1 + event_id % 64 AS tokens_in, 1 + event_id % 32 AS tokens_out,
    (event_id % 16) / 8.0::DOUBLE AS latency_s, (event_id % 64) / 1024.0::DOUBLE AS cost,
    event_type = 'purchase' AS passed,
    CASE WHEN event_type = 'error' THEN 'TimeoutError: slow' ELSE '' END AS error,
    props AS raw_output, 'fix ' || event_type AS feedback
  FROM events
)"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge replies, one per document; scores of every JSON type."""
    key = F.col("doc_id")
    eighth = ((key % 9) / 8).cast("string")
    score = (
        F.when(key % 5 == 0, eighth)
        .when(key % 5 == 1, F.lit('"0.9"'))
        .when(key % 5 == 2, F.lit("true"))
        .when(key % 5 == 3, F.lit("7"))
    )
    flag = (
        F.when(key % 4 == 0, "true")
        .when(key % 4 == 1, "false")
        .when(key % 4 == 2, '"false"')
        .otherwise("0")
    )
    note = F.to_json(F.struct(F.col("text").alias("rationale")))
    note_field = F.substr(note, F.lit(2), F.length(note) - 2)
    review = F.concat(
        F.lit('"readability": {"score": '), eighth, F.lit(', "note": "n'), (key % 3).cast("string"),
        F.lit('"}, "eloquence": {"score": 0.5}, "waiting_layer": '),
        F.when(key % 2 == 0, F.lit('{"score": 0.25, "note": "w"}')).otherwise(F.lit("0.75")),
    )
    document = F.concat(
        F.lit("{"),
        F.when(score.isNotNull(), F.concat(F.lit('"score": '), score, F.lit(", "))).otherwise(""),
        F.lit('"hallucinated": '), flag, F.lit(", "), review, F.lit(", "), note_field, F.lit("}"),
    )
    reply = (
        F.when(key % 7 == 6, F.lit("no json here"))
        .when(key % 7 == 5, F.concat(document, F.lit(" and {x}")))
        .otherwise(F.concat(F.lit("Here: "), document))
    )
    return table(spark, sf_dir, "documents").select("doc_id", "text", reply.alias("reply"))


_REPLIES_SQL = """
v_replies AS (
  SELECT doc_id, text, doc_id % 7 < 5 AS valid,
    CASE doc_id % 5 WHEN 0 THEN (doc_id % 9) / 8.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE WHEN 2 THEN 1.0::DOUBLE WHEN 3 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
    doc_id % 4 IN (0, 2) AS flag
  FROM documents
)"""


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Human labels beside an automatic verdict on the same document."""
    verdict = F.when(F.col("n_chars") > 2000, 1.0).when(F.col("n_chars") > 400, 0.5).otherwise(0.0)
    word = F.get(
        F.array(F.lit("no"), F.lit("partial"), F.lit("yes")), F.col("quality") + F.col("toxic")
    )
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "source")
    return (
        table(spark, sf_dir, "labels")
        .join(docs, "doc_id")
        .select(
            F.col("doc_id").alias("item"),
            word.alias("technique_present"),
            (1 + F.col("quality") * 2 + F.col("toxic")).alias("craft"),
            verdict.alias("auto_strength"),
            F.col("n_chars").alias("judge_score"),
        )
    )


_LABELS_SQL = """
v_labels AS (
  SELECT doc_id AS item, (['no','partial','yes'])[quality + toxic + 1] AS technique_present,
    1 + quality * 2 + toxic AS craft,
    CASE WHEN n_chars > 2000 THEN 1.0::DOUBLE WHEN n_chars > 400 THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS auto_strength,
    n_chars AS judge_score
  FROM labels JOIN documents USING (doc_id)
)"""

_ARRIVED_SQL = _SCORED_SQL.split("v_scored AS (")[1].join(["v_arrived AS (", ""]).replace(
    "SELECT model_slug, track, sample_id, trial,",
    f"SELECT model_slug, track, sample_id, trial, l_linenumber, {_ARRIVAL_SQL},",
    1,
)


def flow_responses(spark: SparkSession, sf_dir: str, extra: tuple[str, ...] = ()) -> DataFrame:
    """Responses whose samples are parts, with output fit for the sample's track, and extra line-item columns."""
    number = F.col("l_partkey") + F.col("l_linenumber")
    code = fenced(number, snippet(number, F.col("l_returnflag")))
    return (
        heavy_table(spark, sf_dir, "lineitem")
        .withColumns({"code": code, "track": _track("l_partkey")})
        .selectExpr(
            _TASK_KEY[0],
            "track",
            "concat('p', l_partkey) AS sample_id",
            _TASK_KEY[3],
            "'openrouter' AS provider",
            "cast((l_partkey + l_linenumber) % 4 AS int) AS attempts",
            "cast(l_quantity * 5 AS bigint) AS tokens_in",
            "cast(l_quantity * 10 AS bigint) AS tokens_out",
            "(l_quantity + l_linenumber) / 8 AS latency_s",
            "l_quantity / 1024 AS cost",
            "CASE track WHEN 'bug_localization' THEN concat('{\"line\": ', l_partkey % 50 + 1, ', \"proposed_fix\": \"done(1)\"}') "
            "WHEN 'test_case_design' THEN '{\"test_cases\": []}' ELSE code END AS raw_output",
            *extra,
        )
    )


def flow_logs(responses: DataFrame) -> DataFrame:
    """One execution log per response key; every eleventh sample has none."""
    keys = responses.select(*fixed.KEY_COLUMNS).distinct()
    part = "cast(substring(sample_id, 2) AS bigint)"
    blob = (
        f"concat('{{\"tests_total\": 5, \"tests_failing_on_correct\": ', {part} % 2, ', \"collection_ok\": true, "
        f"\"coverage_pct\": 50, \"mutants_total\": 4, \"mutants_killed\": ', {part} % 5, '}}')"
    )
    return keys.filter(f"{part} % 11 <> 0").selectExpr(
        *fixed.KEY_COLUMNS,
        f"cast(({part} + trial) % 3 AS int) AS exit_code",
        f"{part} % 7 = 0 AS timed_out",
        f"concat('{fixed.RESULT_MARKER}\\n', {blob}) AS stdout",
        "'' AS stderr",
    )


SQL = {
    "scored": (_SCORED_SQL,),
    "arrived": (_SCORED_SQL, _ARRIVED_SQL),
    "texts": (_TEXTS_SQL,),
    "responses": (_SCORED_SQL, _RESPONSES_SQL),
    "models": (_MODELS_SQL,),
    "samples": (_SAMPLES_SQL,),
    "localization": (_SAMPLES_SQL, _LOCALIZATION_SQL),
    "exec": (_EXEC_SQL,),
    "attempts": (_ATTEMPTS_SQL,),
    "replies": (_REPLIES_SQL,),
    "labels": (_LABELS_SQL,),
}


def with_bindings(names: str, body: str) -> str:
    """The SQL text with the named bindings, and any CTEs of its own, in front."""
    parts: list[str] = []
    for name in names.split():
        for cte in SQL[name]:
            if cte not in parts:
                parts.append(cte)
    body = body.strip()
    own = body[len("WITH ") :] if body.upper().startswith("WITH ") else None
    if own is not None:
        return "WITH " + ",".join(parts) + ",\n" + own
    return "WITH " + ",".join(parts) + "\n" + body

