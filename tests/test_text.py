"""Parsers, lexers, detectors and craft signals on snippets made for each rule."""

from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.functions.lexing import braces_balance, strip_comments, strip_noise
from scorelake.functions.parsing import code_block, with_json_object, with_judge_json
from scorelake.operators import text_features

BLOCKS = [
    ("see below\n```py\ntotal = 3\n```\nthat is all", ("python", "py"), "total = 3"),
    ("```bash\nls\n```\nthen\n```ts\nrun();\n```", ("ts", "js"), "run();"),
    ("```bash\nls\n```\nthen\n```ts\nrun();\n```", ("rust",), "ls"),
    ("\t just words \n", (), "just words"),
    ("cut off:\n```js\nlet k;\n", ("js",), "let k;"),
    ("```\nunnamed\n```", ("js",), "unnamed"),
    ("ticks ``` in a line", ("js",), "ticks ``` in a line"),
    ("", (), ""),
]


@pytest.mark.parametrize("text,prefer,expected", BLOCKS)
def test_code_block(spark, text, prefer, expected):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(code_block(F.col("t"), prefer).alias("c")).first().c == expected


def test_json_objects(spark):
    cases = [
        ('```json\n{"row": [1, 2]}\n```', {"row": [1, 2]}),
        ('the answer is {"start": 4} I think', {"start": 4}),
        ("nothing to read", {}),
        ('{"x": 0} or {"y": 0}', {}),
        ('{"x": 0, "x": 5}', {"x": 5}),
        ("{x: 0}", {}),
        ('```js\n{ open\n```\n{"fine": null}', {}),
        ('```js\ngo();\n```\n{"fine": false}', {"fine": False}),
        ('{"x": NaN}', {"x": {"nan": None}}),
        (None, {}),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: json.loads(r.j) for r in with_json_object(df, "t", "j").collect()}
    assert [got[i] for i in range(len(cases))] == [e for _, e in cases]
    judged = spark.createDataFrame([('```json\n{"x": 0}\n``` {',)], "t string")
    assert with_judge_json(judged, "t", "j").first().j == '{"x": 0}'


def scan(text: str) -> list[tuple[str, str]]:
    """Pieces of code as (kind, text), read one character at a time; an open literal is plain."""
    pieces, at = [], 0
    while at < len(text):
        c, end, kind = text[at], at + 1, "plain"
        if c in "\"'`":
            close = at + 1
            while close < len(text) and text[close] != c:
                close += 2 if text[close] == "\\" else 1
            if close < len(text):
                end, kind = close + 1, "literal"
        elif text.startswith("//", at):
            stop = text.find("\n", at)
            end, kind = (len(text) if stop < 0 else stop), "comment"
        elif text.startswith("/*", at) and (stop := text.find("*/", at + 2)) >= 0:
            end, kind = stop + 2, "comment"
        pieces.append((kind, text[at:end]))
        at = end
    return pieces


def without(text: str, *kinds: str) -> str:
    return "".join(" " if kind in kinds else part for kind, part in scan(text))


def test_lexers_equal_a_scanner(spark):
    pick = random.Random(3)
    alphabet = ['"', "'", "`", "//", "/*", "*/", "\\", "\n", "a", " ", "{", "}", "é", "/", "x('y')"]
    texts = ["".join(pick.choices(alphabet, k=pick.randint(0, 40))) for _ in range(3000)]
    texts += ['go("ftp://b"); // why', "`" + "y" * 60_000 + "`", "'" + "\\t" * 25_000 + "'"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select(
        "i", strip_comments(F.col("t")).alias("code"), strip_noise(F.col("t")).alias("bare")
    ).collect()
    for row in got:
        text = texts[row.i]
        assert row.code == without(text, "comment"), text
        assert row.bare == without(text, "comment", "literal"), text


def test_braces(spark):
    df = spark.createDataFrame([("if (a) { '}' }",), ("}",), (" \n",)], "t string")
    got = df.select(braces_balance(F.col("t"), strip_noise(F.col("t"))).alias("b")).collect()
    assert [r.b for r in got] == [True, False, False]


def features(spark, code, expected=None):
    df = spark.createDataFrame([(code, expected)], "parsed string, expected_pattern string")
    return text_features.e2e_features(df).first()


TECHNIQUES = {
    "page_object": "class BasketPage { open() { return this.page.reload(); } }",
    "structure": "function addItem(page, name) { return page.keyboard.type(name); }",
    "fixtures": "const it = test.extend({ basket: async ({}, give) => give([]) });",
    "network": "await context.route(/items/, handler => handler.continue());",
    "polling": "await expect(async () => check()).toPass();",
    "api": "const reply = await request.get('/items');",
    "download": "const name = file.suggestedFilename();",
    "accessibility": "const tree = await page.accessibility.snapshot();",
    "performance": "const watch = new PerformanceObserver(list => keep(list));",
    "realtime": "const session = await context.newCDPSession(page); session as CDPSession;",
}


@pytest.mark.parametrize("name", TECHNIQUES)
def test_technique_detected(spark, name):
    row = features(spark, TECHNIQUES[name], name)
    assert row[f"uses_{name}"] is True
    assert row.pattern_used == 1.0
    assert row.pattern_attempted is True


GRADES = [
    ("polling", "await expect(basket).toHaveCount(3);", 0.5),
    ("fixtures", "beforeAll(seed); it.use({ storageState: saved });", 0.5),
    ("fixtures", "it.use({ storageState: saved });", 1.0),
    ("fixtures", "test.beforeEach(seed);", 0.0),
    ("network", "await basket.click();", 0.0),
    ("network", "/* context.route( */ const s = 'x.route(';", 0.0),
    ("telepathy", "await context.route(/items/, stop);", 0.0),
    (None, "await context.route(/items/, stop);", None),
    ("", "await context.route(/items/, stop);", None),
]


@pytest.mark.parametrize("expected,code,credit", GRADES)
def test_graded_credit(spark, expected, code, credit):
    assert features(spark, code, expected).pattern_used == credit


STRUCTURES = [
    ("class Basket {\n  page: Page;\n}", True),
    ("class Item { price = 3; }", False),
    ("const buyer = new Actor('b');", True),
    ("it('opens', async ({ page }) => page.reload());", False),
    ("const addItem = (page, n) => n;", True),
]


@pytest.mark.parametrize("code,expected", STRUCTURES)
def test_structure(spark, code, expected):
    assert features(spark, code).uses_structure is expected


CRAFT = [
    ("assertion_quality", "await expect(row).toBeVisible();", 1.0),
    ("assertion_quality", "await expect(row).toBeVisible(); expect(await row.count()).toBe(1);", 0.5),
    ("assertion_quality", "await row.click();", None),
    ("waiting_quality", "await page.waitForURL('/done');", 1.0),
    ("waiting_quality", "await page.waitForURL('/done'); await page.waitForTimeout(9);", 0.5),
    ("waiting_quality", "await page.waitForTimeout(9);", 0.0),
    ("teardown_hygiene", "const c = await browser.newContext(); await c.close();", 1.0),
    ("teardown_hygiene", "const c = await browser.newContext();", 0.0),
    ("teardown_hygiene", "await row.click();", None),
    ("uses_unique_data", "const n = faker.word();", True),
    ("uses_unique_data", "const n = 'fixed';", False),
    ("uses_hardcoded_url", "await page.goto(\"https://shop.test/\");", True),
    ("uses_hardcoded_url", "await page.goto('/');", False),
    ("has_code_smell", "const all = document.querySelectorAll('p');", True),
    ("has_code_smell", "await page.getByLabel('p').fill('x');", False),
    ("dry_score", "await next();\nawait next();\nawait next();\nawait stop();", 0.5),
    ("dry_score", "await next();\nawait stop();", None),
    ("selectors_robust", "await page.getByText('ok').click(); // li:nth-child(1)", True),
    ("selectors_robust", "await page.getByText('ok').click(); page.locator('li:nth-child(1)');", False),
]


@pytest.mark.parametrize("name,code,expected", CRAFT)
def test_craft(spark, name, code, expected):
    assert features(spark, code)[name] == expected


def test_static_signals(spark):
    suite = "from urllib import request\ndef test_sum():\n    assert sum([]) == 0\n"
    df = spark.createDataFrame([(suite,), ("class :",), (None,)], "code string")
    got = text_features.with_static_tests(df, "code").collect()
    assert [r.static_parses for r in got] == [True, False, None]
    assert got[0].static_has_assert is True
    assert got[0].static_no_network is False


def test_needles_never_hide_a_match(spark):
    """Flags with keyword guards equal the bare patterns on a mixed corpus."""
    corpus = list(TECHNIQUES.values()) + [c for _, c, _ in GRADES] + [c for c, _ in STRUCTURES] + [c for _, c, _ in CRAFT]
    corpus += [a + "\n" + b for a in corpus[:8] for b in corpus[8:]]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(corpus)], "i int, parsed string")
    df = df.withColumn("expected_pattern", F.lit(None).cast("string"))
    plain = {
        "uses_fixtures": fixed.FIXTURES,
        "uses_network": fixed.NETWORK,
        "uses_polling": fixed.POLLING,
        "uses_api": fixed.API,
        "uses_accessibility": fixed.ACCESSIBILITY,
        "uses_performance": fixed.PERFORMANCE,
        "uses_realtime": fixed.REALTIME,
        "uses_arbitrary_timeout": fixed.ARBITRARY_WAIT,
    }
    for row in text_features.e2e_features(df).collect():
        bare = without(corpus[row.i], "comment", "literal")
        for flag, pattern in plain.items():
            assert row[flag] == bool(re.search(pattern, bare)), (flag, corpus[row.i])
