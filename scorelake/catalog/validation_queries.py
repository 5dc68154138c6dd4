"""Label agreement, rank correlation, audits, prompt drift, leak scan and label sheets."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from scorelake import fixed_values as fixed
from scorelake.catalog import bindings
from scorelake.catalog.bindings import with_bindings
from scorelake.operators import validation
from scorelake.plans import scoring
from scorelake.sources import datasets, golden
from scorelake.sources.workspace import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _pairs(spark, sf_dir):
    labels = bindings.labels(spark, sf_dir)
    human = labels.select("item", "technique_present", "craft")
    key = labels.select("item", "auto_strength", "judge_score")
    pairs = validation.labelled_verdicts(human, key)
    return pairs.withColumn("human_strength", validation.level(F.col("technique_present")))


_PAIRS = """WITH pairs AS (SELECT *, CASE technique_present WHEN 'yes' THEN 1.0::DOUBLE WHEN 'partial' THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END AS human_strength FROM v_labels)"""


def labelled_verdicts(spark, sf_dir):
    """Human label and automatic verdict per item."""
    return _pairs(spark, sf_dir).select("item", "technique_present", "human_strength", "auto_strength")


SQL["labelled_verdicts"] = with_bindings(
    "labels", f"{_PAIRS} SELECT item, technique_present, human_strength, auto_strength FROM pairs"
)


def label_agreement(spark, sf_dir):
    """Exact agreement on the graded scale."""
    return validation.agreement(_pairs(spark, sf_dir), "human_strength", "auto_strength")


SQL["label_agreement"] = with_bindings(
    "labels",
    f"{_PAIRS} SELECT count(*) AS n_items, avg(CAST(human_strength = auto_strength AS INTEGER)) AS agreement FROM pairs",
)


def label_confusion(spark, sf_dir):
    """Confusion counts of labels and verdicts."""
    return validation.confusion(_pairs(spark, sf_dir), "technique_present", "auto_strength")


SQL["label_confusion"] = with_bindings(
    "labels",
    """SELECT technique_present, count(*) FILTER (auto_strength = 1) AS auto_yes, count(*) FILTER (auto_strength = 0.5) AS auto_partial,
         count(*) FILTER (auto_strength = 0) AS auto_no FROM v_labels GROUP BY 1""",
)


def rank_correlation(spark, sf_dir):
    """Spearman correlation of human craft and judge score."""
    rho = validation.rank_correlation(_pairs(spark, sf_dir), "craft", "judge_score")
    return rho.withColumn("rank_correlation", F.round("rank_correlation", 10))


SQL["rank_correlation"] = with_bindings(
    "labels",
    """WITH ranks AS (SELECT rank() OVER (ORDER BY craft) + (count(*) OVER (PARTITION BY craft) - 1) / 2 AS x,
         rank() OVER (ORDER BY judge_score) + (count(*) OVER (PARTITION BY judge_score) - 1) / 2 AS y FROM v_labels)
       SELECT count(*) AS n_items, round(corr(x, y), 10) AS rank_correlation FROM ranks""",
)


def event_rank_correlation(spark, sf_dir):
    """Spearman correlation of event value and user, over every event."""
    events = bindings.table(spark, sf_dir, "events").select("value", "user_id")
    rho = validation.rank_correlation(events, "value", "user_id")
    return rho.withColumn("rank_correlation", F.round("rank_correlation", 10))


SQL["event_rank_correlation"] = """
WITH ranks AS (SELECT rank() OVER (ORDER BY value) + (count(*) OVER (PARTITION BY value) - 1) / 2 AS x,
  rank() OVER (ORDER BY user_id) + (count(*) OVER (PARTITION BY user_id) - 1) / 2 AS y FROM events WHERE value IS NOT NULL AND user_id IS NOT NULL)
SELECT count(*) AS n_items, round(corr(x, y), 10) AS rank_correlation FROM ranks"""


def average_ranks(spark, sf_dir):
    """Average-tie rank of every order price."""
    counts = bindings.table(spark, sf_dir, "lineitem").groupBy("l_quantity").agg(
        F.count(F.lit(1)).alias("n")
    )
    return validation.average_ranks(counts, "l_quantity", "n")


SQL["average_ranks"] = """
SELECT DISTINCT l_quantity, rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2 AS l_quantity_rank FROM lineitem"""


def error_audit(spark, sf_dir):
    """Errors by kind per model and track."""
    rows = bindings.responses(spark, sf_dir).withColumn(
        "score_design_error", F.when(F.col("attempts") == 0, "402")
    )
    return validation.error_audit(rows)


SQL["error_audit"] = with_bindings(
    "responses",
    """SELECT model_slug, track, count(*) AS n_rows, count(nullif(error, '')) AS n_error, count(*) FILTER (attempts = 0) AS n_score_design_error
       FROM v_responses GROUP BY 1, 2""",
)


def captured_errors(spark, sf_dir):
    """Errors of a user's scorer, which fails on some rows, and what it gives on the others."""
    outputs = T.StructType([T.StructField("tokens_per_try", T.LongType())])
    scorer = scoring.captured("tries", lambda row: {"tokens_per_try": row["tokens_out"] // row["attempts"]}, ["tokens_out", "attempts"], outputs)
    rows = scorer(bindings.responses(spark, sf_dir).select("model_slug", "track", "tokens_out", "attempts"))
    audit = validation.error_audit(rows)
    totals = rows.groupBy("model_slug", "track").agg(F.sum("tokens_per_try").alias("tokens_per_try"), F.min("tries_error").alias("first_error"))
    return audit.join(totals, ["model_slug", "track"])


SQL["captured_errors"] = with_bindings(
    "responses",
    """SELECT model_slug, track, count(*) AS n_rows, count(*) FILTER (attempts = 0) AS n_tries_error,
         CAST(sum(tokens_out // nullif(attempts, 0)) AS BIGINT) AS tokens_per_try,
         CASE WHEN count(*) FILTER (attempts = 0) > 0 THEN 'ZeroDivisionError: integer division or modulo by zero' END AS first_error
       FROM v_responses GROUP BY 1, 2""",
)


def _prompted(spark, sf_dir):
    rows = bindings.table(spark, sf_dir, "lineitem").withColumn("track", bindings._track("l_orderkey"))
    changed = (F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A")
    return rows.select(
        F.col("l_returnflag").alias("run_id"),
        "track",
        F.left(F.sha2(F.concat("track", F.when(changed, "b").otherwise("a")), 256), F.lit(12)).alias("prompt_hash"),
    )


_PROMPTED = """prompted AS (SELECT l_returnflag AS run_id, track,
  left(sha256(track || CASE WHEN l_linenumber = 7 AND l_returnflag = 'A' THEN 'b' ELSE 'a' END), 12) AS prompt_hash FROM lineitem_keyed)"""


def prompt_usage(spark, sf_dir):
    """Rows per run, track and prompt."""
    return validation.prompt_usage(_prompted(spark, sf_dir))


SQL["prompt_usage"] = with_bindings(
    "scored",
    f"WITH {_PROMPTED} SELECT run_id, track, prompt_hash, count(*) AS n_rows FROM prompted GROUP BY 1, 2, 3",
)


def prompt_drift(spark, sf_dir):
    """Prompts per run and track, and whether there is more than one."""
    return validation.prompt_drift(_prompted(spark, sf_dir))


SQL["prompt_drift"] = with_bindings(
    "scored",
    f"""WITH {_PROMPTED} SELECT run_id, track, count(DISTINCT prompt_hash) AS n_prompts, count(*) AS n_rows,
          count(DISTINCT prompt_hash) > 1 AS drifted FROM prompted GROUP BY 1, 2""",
)


def leak_scan(spark, sf_dir):
    """Documents that hold a whole sentence of a benchmark item, case-folded."""
    docs = bindings.heavy_table(spark, sf_dir, "documents")
    prompts = docs.select(F.col("doc_id").alias("prompt_id"), "text")
    return validation.leak_scan(prompts, _sentences(spark, sf_dir))


def _sentences(spark, sf_dir):
    items = bindings.table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split("text", r"[.\n]")).alias("position", "sentence")
    )
    return items.select(
        F.concat_ws("-", F.col("item_id").cast("string"), F.col("position").cast("string")).alias("term_id"),
        F.btrim("sentence", F.lit(" ")).alias("term"),
    )


SQL["leak_scan"] = r"""
WITH terms AS (SELECT item_id || '-' || (i - 1) AS term_id, lower(trim(sentences[i], ' ')) AS term
  FROM (SELECT item_id, string_split_regex(text, '[.\n]') AS sentences FROM benchmark), unnest(range(1, len(sentences) + 1)) AS r(i))
SELECT doc_id AS prompt_id, term_id FROM documents JOIN terms ON term <> '' AND contains(lower(text), term)"""


def short_leaks(spark, sf_dir):
    """Documents that hold one long word, or three words in a row, of a benchmark item."""
    docs = bindings.heavy_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("prompt_id"), "text")
    items = bindings.table(spark, sf_dir, "benchmark")
    terms = [
        items.select(F.concat(F.lit(kind), F.col("item_id").cast("string")).alias("term_id"), F.regexp_extract("text", pattern, 0).alias("term"))
        for kind, pattern in (("w", _LONG_WORD), ("t", _THREE_WORDS))
    ]
    return validation.leak_scan(docs, terms[0].unionByName(terms[1]))


_LONG_WORD, _THREE_WORDS = "[A-Za-z]{9,}", "[A-Za-z]+ [A-Za-z]+ [A-Za-z]+"
SQL["short_leaks"] = f"""
WITH terms AS (SELECT 'w' || item_id AS term_id, lower(regexp_extract(text, '{_LONG_WORD}')) AS term FROM benchmark
  UNION ALL SELECT 't' || item_id, lower(regexp_extract(text, '{_THREE_WORDS}')) FROM benchmark)
SELECT doc_id AS prompt_id, term_id FROM documents JOIN terms ON term <> '' AND contains(lower(text), term)"""

# Terms that would give a technique away.
_GIVEAWAYS = ("page object", "fixture", "intercept", "route(", "expected_pattern", "th the")


def prompt_leaks(spark, sf_dir):
    """Whether each document holds one of a few fixed terms."""
    docs = bindings.table(spark, sf_dir, "documents")
    return docs.select("doc_id", validation.leaks_any(F.col("text"), _GIVEAWAYS).alias("leaks"))


SQL["prompt_leaks"] = (
    "SELECT doc_id, "
    + " OR ".join(f"contains(lower(text), '{t}')" for t in _GIVEAWAYS)
    + " AS leaks FROM documents"
)


def label_sheets(spark, sf_dir):
    """Label rows parsed out of worksheets, two items per labelled document."""
    labels = bindings.table(spark, sf_dir, "labels")
    docs = bindings.table(spark, sf_dir, "documents").select("doc_id", "text")
    word = F.when(F.col("quality") == 1, "yes").otherwise("partial")

    def section(number, craft):
        return F.concat(
            F.lit("## Item "), number.cast("string"), F.lit(" — expected technique: `api`\n"),
            F.lit("*Success condition:* ok\n\n```ts\n"), F.col("text"), F.lit("\n```\n\n- technique_present:  "),
            word, F.lit("\n- craft (1-5):  "), craft, F.lit("\n- notes: label "), number.cast("string"), F.lit("\n\n---\n\n"),
        )

    number = F.col("doc_id") * 2
    sheet = F.concat(F.lit("# Golden labels\n\n"), section(number, F.lit("4")), section(number + 1, F.lit("")))
    return golden.parse_worksheets(labels.join(docs, "doc_id").select(sheet.alias("text")))


SQL["label_sheets"] = """
SELECT CAST(doc_id * 2 + i AS INTEGER) AS item, 'api' AS expected_pattern, CASE WHEN quality = 1 THEN 'yes' ELSE 'partial' END AS technique_present,
  CASE WHEN i = 0 THEN 4 END AS craft, 'label ' || (doc_id * 2 + i) AS notes
FROM labels JOIN documents USING (doc_id), (SELECT unnest([0, 1]) AS i)"""


def key_sheets(spark, sf_dir):
    """Key rows parsed out of JSON sheets, two items per labelled document."""
    labels = bindings.table(spark, sf_dir, "labels")
    number = F.col("doc_id") * 2

    def entry(item, more):
        return F.concat(F.lit('{"item": '), item.cast("string"), F.lit(', "sample_id": "d'), F.col("doc_id").cast("string"), F.lit('"'), more, F.lit("}"))

    verdict = F.concat(F.lit(', "auto_pattern_used": '), (F.col("quality") == 1).cast("string"), F.lit(', "trial": 2'))
    sheet = F.concat(F.lit("[\n  "), entry(number, verdict), F.lit(",\n  "), entry(number + 1, F.lit(', "model_slug": null')), F.lit("\n]\n"))
    return golden.parse_keys(labels.select(sheet.alias("text")))


SQL["key_sheets"] = """
SELECT CAST(doc_id * 2 + i AS INTEGER) AS item, 'd' || doc_id AS sample_id, NULL::VARCHAR AS expected_pattern, NULL::VARCHAR AS model_slug,
  CASE WHEN i = 0 THEN 2 END AS trial, CASE WHEN i = 0 THEN quality = 1 END AS auto_pattern_used, NULL::BOOLEAN AS auto_e2e_passed
FROM labels, (SELECT unnest([0, 1]) AS i)"""


# Files of a sample by track: name, text as SQL that both engines read. doc_id tells the track.
_FILES = {
    "unit_test_gen": (("source.py", "text"), ("meta.json", "concat('{\"module_name\": \"mod', doc_id, '\"}')"), ("mutants/m1.py", "lower(lang)"), ("mutants/m0.py", "upper(lang)")),
    "bug_localization": (("buggy.py", "text"), ("meta.json", "concat('{\"module_name\": \"mod', doc_id, '\", \"fault_lines\": [', doc_id % 9 + 1, '], \"symptom\": \"s', doc_id, '\"}')"), ("test_hidden.py", "lang")),
    "test_case_design": (("requirement.md", "text"), ("reference_classes.json", "concat('{\"equivalence_classes\": [\"c', doc_id, '\"], \"boundary_values\": [', doc_id % 7, ']}')"), ("meta.json", "'{}'")),
    "e2e_ui": (("flow.md", "text"), ("meta.json", "CASE WHEN doc_id % 4 < 2 THEN concat('{\"success_assertion\": \"ok', doc_id, '\"}') ELSE '{}' END")),
    "e2e_advanced": (("flow.md", "text"), ("meta.json", "concat('{\"expected_pattern\": \"api\", \"base_url\": \"http://h', doc_id, '\"}')")),
    "e2e_repair": (("broken.spec.ts", "text"), ("error.txt", "lang"), ("meta.json", "'{}'")),
}


def _shape_files(spark, sf_dir):
    """The files of a sample per document, of all six shapes."""
    docs = bindings.table(spark, sf_dir, "documents").withColumn("track", bindings._track("doc_id"))
    named = F.array(*(F.struct(F.lit(t).alias("of"), F.lit(n).alias("relpath"), F.expr(text).alias("text")) for t, files in _FILES.items() for n, text in files))
    files = docs.select("track", F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample_id"), F.inline(named))
    return files.filter("of = track").drop("of")


def _shown_shapes(samples):
    return samples.select(
        "track", "sample_id", "language", "payload.source", "payload.module_name", F.array_join("payload.mutants", "|").alias("mutants"),
        F.array_join(F.col("payload.fault_lines").cast("array<string>"), "|").alias("faults"), "payload.symptom", "payload.test", "payload.requirement",
        F.array_join("payload.reference.equivalence_classes", "|").alias("classes"), "payload.flow", "payload.base_url", "payload.success",
        "payload.expected_pattern", "payload.broken_test", "payload.error",
    )


def assembled_shapes(spark, sf_dir):
    """Samples of all six shapes assembled from their files, one per document."""
    return _shown_shapes(datasets.assemble_samples(_shape_files(spark, sf_dir)))


def sample_folders(spark, sf_dir):
    """The same samples through a folder each: their files written, listed and read back."""
    root = new_folder(spark, "samples")
    datasets.write_sample_files(_shape_files(spark, sf_dir), root)
    return _shown_shapes(datasets.read_samples(spark, root))


def prompt_folder(spark, sf_dir):
    """Prompt files, one per document, written and read back with name and hash."""
    root = new_folder(spark, "prompts")
    path = F.concat(F.lit("t"), F.col("doc_id").cast("string"), F.lit(".md"))
    docs = bindings.table(spark, sf_dir, "documents")
    datasets.write_texts(docs.select(path.alias("path"), F.concat(F.lit("\n"), "text", F.lit(" \n")).alias("text")), root)
    return datasets.read_prompts(spark, root)


_URLS = " ".join(f"WHEN '{t}' THEN '{url}'" for t, url in fixed.DEFAULT_BASE_URL.items())
SQL["assembled_shapes"] = f"""
WITH d AS (SELECT *, doc_id % 6 AS k, (['unit_test_gen','bug_localization','test_case_design','e2e_ui','e2e_advanced','e2e_repair'])[doc_id % 6 + 1] AS track FROM documents)
SELECT track, 'd' || doc_id AS sample_id, CASE WHEN k < 2 THEN 'python' WHEN k = 2 THEN 'none' ELSE 'typescript' END AS language,
  CASE WHEN k < 2 THEN text END AS source, CASE WHEN k < 2 THEN 'mod' || doc_id END AS module_name, CASE WHEN k = 0 THEN upper(lang) || '|' || lower(lang) END AS mutants,
  CASE WHEN k = 1 THEN CAST(doc_id % 9 + 1 AS VARCHAR) END AS faults, CASE WHEN k = 1 THEN 's' || doc_id END AS symptom, CASE WHEN k = 1 THEN lang END AS test,
  CASE WHEN k = 2 THEN text END AS requirement, CASE WHEN k = 2 THEN 'c' || doc_id END AS classes, CASE WHEN k IN (3, 4) THEN text END AS flow,
  CASE WHEN k = 4 THEN 'http://h' || doc_id ELSE CASE track {_URLS} END END AS base_url,
  CASE WHEN k = 3 AND doc_id % 4 < 2 THEN 'ok' || doc_id WHEN k >= 3 THEN '' END AS success,
  CASE WHEN k = 4 THEN 'api' WHEN k = 5 THEN '' END AS expected_pattern, CASE WHEN k = 5 THEN text END AS broken_test, CASE WHEN k = 5 THEN lang END AS error
FROM d"""


SQL["sample_folders"] = SQL["assembled_shapes"]


def assembled_samples(spark, sf_dir):
    """Unit-test samples assembled from dataset files, four files to a document."""
    docs = bindings.table(spark, sf_dir, "documents")
    meta = F.concat(F.lit('{"module_name": "mod'), F.col("doc_id").cast("string"), F.lit('"}'))
    files = F.array(
        *(
            F.struct(F.lit(name).alias("relpath"), text.alias("text"))
            for name, text in (
                ("mutants/m1.py", F.lower("text")),
                ("source.py", F.col("text")),
                ("meta.json", meta),
                ("mutants/m0.py", F.upper("lang")),
            )
        )
    )
    rows = docs.select(
        F.lit("unit_test_gen").alias("track"),
        F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("sample_id"),
        F.inline(files),
    )
    samples = datasets.assemble_samples(rows)
    return samples.select(
        "track", "sample_id", "language", "payload.source", "payload.module_name",
        F.array_join("payload.mutants", "|").alias("mutants"),
    )


SQL["assembled_samples"] = """
SELECT 'unit_test_gen' AS track, 'd' || doc_id AS sample_id, 'python' AS language, text AS source, 'mod' || doc_id AS module_name,
  upper(lang) || '|' || lower(text) AS mutants FROM documents"""


def prompt_texts(spark, sf_dir):
    """Prompt texts with name and hash, one per document."""
    docs = bindings.table(spark, sf_dir, "documents")
    path = F.concat(F.lit("file:/prompts/t"), F.col("doc_id").cast("string"), F.lit(".md"))
    return datasets.prompt_rows(docs.select(path.alias("path"), F.concat(F.lit("\n"), "text", F.lit(" \n")).alias("text")))


SQL["prompt_texts"] = r"""
WITH t AS (SELECT 't' || doc_id AS track, regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS text FROM documents)
SELECT track, text, left(sha256(text), 12) AS prompt_hash FROM t"""

SQL["prompt_folder"] = SQL["prompt_texts"]

for _fn in (
    labelled_verdicts, label_agreement, label_confusion, rank_correlation, event_rank_correlation,
    average_ranks, error_audit, captured_errors, prompt_usage, prompt_drift, leak_scan, short_leaks, prompt_leaks, label_sheets,
    assembled_samples, assembled_shapes, sample_folders, key_sheets, prompt_texts, prompt_folder,
):
    QUERIES[_fn.__name__] = _fn
