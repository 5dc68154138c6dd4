"""Selection, planning, resuming, prompts, usage and attempt queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake.catalog import bindings
from scorelake.catalog.bindings import with_bindings
from scorelake.dimensions import track_dimension
from scorelake.functions import prompting
from scorelake.functions.judging import request_key
from scorelake.functions.values import round_half_even
from scorelake.operators import attempts, planning, rejudge
from scorelake.plans import scoring
from scorelake.sources.workspace import new_folder

QUERIES: dict = {}
SQL: dict[str, str] = {}

# --- Models and tracks ----------------------------------------------------------


def select_default_models(spark, sf_dir):
    """Models that are not skipped by default."""
    return planning.select_models(bindings.models(spark, sf_dir), "all").select("slug", "id")


SQL["select_default_models"] = with_bindings(
    "models", "SELECT slug, id FROM v_models WHERE NOT skip_by_default"
)


def select_listed_models(spark, sf_dir):
    """Models of a list, in the order of the list."""
    chosen = planning.select_models(bindings.models(spark, sf_dir), "m7, m3,m9")
    return chosen.select(F.col("position").cast("long").alias("position"), "slug", "id")


SQL["select_listed_models"] = with_bindings(
    "models",
    """WITH wanted AS (SELECT unnest(['m7', 'm3', 'm9']) AS slug, unnest([0, 1, 2]) AS position)
       SELECT CAST(position AS BIGINT) AS position, slug, id FROM wanted JOIN v_models USING (slug)""",
)


def model_labels(spark, sf_dir):
    """Labels with the slug as default."""
    return planning.with_labels(bindings.models(spark, sf_dir)).select("slug", "label")


SQL["model_labels"] = with_bindings(
    "models", "SELECT slug, CASE WHEN label = '' THEN slug ELSE label END AS label FROM v_models"
)


def unknown_models(spark, sf_dir):
    """Model slugs of responses that the registry does not have."""
    used = bindings.responses(spark, sf_dir).select(F.col("model_slug").alias("slug"))
    return planning.unknown_names(used, bindings.models(spark, sf_dir), "slug")


SQL["unknown_models"] = with_bindings(
    "responses",
    """SELECT DISTINCT model_slug AS slug FROM v_responses
       WHERE model_slug NOT IN (SELECT 'm' || CAST(s_suppkey AS VARCHAR) FROM supplier)""",
)


def select_tracks(spark, sf_dir):
    """Row counts of the tracks of a list, with their category."""
    tracks = planning.select_tracks(track_dimension(spark), "e2e_repair, unit_test_gen")
    rows = bindings.scored(spark, sf_dir).groupBy("track").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(tracks, "track").select("track", "category", "headline", "n_rows")


SQL["select_tracks"] = with_bindings(
    "scored",
    """SELECT track, CASE track WHEN 'unit_test_gen' THEN 'component' ELSE 'system' END AS category, true AS headline,
         count(*) AS n_rows FROM v_scored WHERE track IN ('e2e_repair', 'unit_test_gen') GROUP BY track""",
)


def headline_rows(spark, sf_dir):
    """Rows per track that count toward the headline score."""
    tracks = track_dimension(spark).filter("headline").select("track", "category")
    rows = bindings.scored(spark, sf_dir).groupBy("track").agg(F.count(F.lit(1)).alias("n_rows"))
    return rows.join(tracks, "track")


SQL["headline_rows"] = with_bindings(
    "scored",
    """SELECT track, CASE WHEN track LIKE 'e2e%' THEN 'system' ELSE 'component' END AS category, count(*) AS n_rows
       FROM v_scored WHERE track <> 'test_case_design' GROUP BY track""",
)

# --- Task plan ------------------------------------------------------------------


def first_samples(spark, sf_dir):
    """The first five samples of every track by id."""
    return planning.first_samples(
        bindings.samples(spark, sf_dir).select("track", "sample_id"), 5
    )


SQL["first_samples"] = with_bindings(
    "samples",
    """SELECT track, sample_id FROM v_samples
       QUALIFY row_number() OVER (PARTITION BY track ORDER BY sample_id) <= 5""",
)


def _task_counts(spark, sf_dir):
    samples = bindings.samples(spark, sf_dir).select("track", "sample_id")
    models = planning.select_models(bindings.models(spark, sf_dir), "all")
    return planning.task_counts(models, samples, trials=2)


def plan_tasks(spark, sf_dir):
    """Planned tasks per model and track over all models, samples and trials."""
    return _task_counts(spark, sf_dir)


SQL["plan_tasks"] = with_bindings(
    "models samples",
    """SELECT slug AS model_slug, track, trial, count(*) AS n_tasks, count(DISTINCT sample_id) AS n_samples
       FROM v_models, v_samples, (SELECT unnest([0, 1]) AS trial) WHERE NOT skip_by_default GROUP BY 1, 2, 3""",
)


def planned_rows(spark, sf_dir):
    """The whole plan written as rows, and a checksum of its keys per model."""
    samples = bindings.samples(spark, sf_dir).select("track", "sample_id")
    path = new_folder(spark, "plan")
    planning.plan_tasks(bindings.models(spark, sf_dir).where("NOT skip_by_default"), samples, trials=2).write.parquet(path)
    key = F.md5(F.concat_ws("/", "model_slug", "track", "sample_id", F.col("trial").cast("string")))
    number = F.conv(F.left(key, F.lit(8)), 16, 10).cast("long")
    return spark.read.parquet(path).groupBy("model_slug").agg(F.count(F.lit(1)).alias("n_tasks"), F.sum(number).alias("checksum"))


SQL["planned_rows"] = with_bindings(
    "models samples",
    """SELECT slug AS model_slug, count(*) AS n_tasks,
         CAST(sum(CAST('0x' || left(md5(concat_ws('/', slug, track, sample_id, CAST(trial AS VARCHAR))), 8) AS BIGINT)) AS BIGINT) AS checksum
       FROM v_models, v_samples, (SELECT unnest([0, 1]) AS trial) WHERE NOT skip_by_default GROUP BY 1""",
)


def plan_limited_tasks(spark, sf_dir):
    """Task rows with three samples per track."""
    samples = bindings.samples(spark, sf_dir).select("track", "sample_id")
    models = bindings.models(spark, sf_dir)
    return planning.plan_tasks(models, samples, trials=3, limit=3)


SQL["plan_limited_tasks"] = with_bindings(
    "models samples",
    """WITH firsts AS (SELECT track, sample_id FROM v_samples
         QUALIFY row_number() OVER (PARTITION BY track ORDER BY sample_id) <= 3)
       SELECT slug AS model_slug, track, sample_id, CAST(trial AS INTEGER) AS trial
       FROM v_models, firsts, (SELECT unnest([0, 1, 2]) AS trial)""",
)


def total_tasks(spark, sf_dir):
    """Number of planned tasks."""
    return planning.total_tasks(_task_counts(spark, sf_dir))


SQL["total_tasks"] = with_bindings(
    "models samples",
    "SELECT count(*) * 2 AS total_tasks FROM v_models, v_samples WHERE NOT skip_by_default",
)


def resume_tasks(spark, sf_dir):
    """Tasks of the observed grid that have no response yet."""
    scored = bindings.scored(spark, sf_dir).select(*fixed.KEY_COLUMNS)
    done = bindings.responses(spark, sf_dir).filter("error = '' AND trial IS NOT NULL")
    return planning.without_done(scored.distinct(), done)


SQL["resume_tasks"] = with_bindings(
    "responses",
    """SELECT DISTINCT model_slug, track, sample_id, trial FROM v_scored
       EXCEPT SELECT model_slug, track, sample_id, trial FROM v_responses WHERE error = '' AND trial IS NOT NULL""",
)


def pending_responses(spark, sf_dir):
    """Responses whose key has not been scored."""
    responses = scoring.base_rows(bindings.responses(spark, sf_dir)).drop("raw_output")
    done = bindings.scored(spark, sf_dir).filter("passed")
    return scoring.pending(responses, done)


_BASE = """model_slug, provider, track, sample_id, coalesce(trial, 0) AS trial,
  CASE WHEN attempts IS NULL OR attempts = 0 THEN 1 ELSE attempts END AS attempts, tokens_in, tokens_out, latency_s, cost"""
SQL["pending_responses"] = with_bindings(
    "responses",
    f"""WITH base AS (SELECT {_BASE} FROM v_responses)
        SELECT * FROM base b WHERE NOT EXISTS (SELECT 1 FROM v_scored s WHERE s.passed AND s.model_slug = b.model_slug
          AND s.track = b.track AND s.sample_id = b.sample_id AND s.trial = b.trial)""",
)


def base_projection(spark, sf_dir):
    """Base columns of scored rows with their defaults."""
    return scoring.base_rows(bindings.responses(spark, sf_dir))


SQL["base_projection"] = with_bindings(
    "responses", f"SELECT {_BASE}, coalesce(raw_output, '') AS raw_output FROM v_responses"
)


def responses_with_samples(spark, sf_dir):
    """Responses joined to their sample; one sample per part."""
    keyed = bindings.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("sample_id")
    )
    samples = bindings.samples(spark, sf_dir)
    rows = keyed.join(samples.select("track", "sample_id"), "sample_id")
    return scoring.with_samples(rows, samples).select(
        "l_orderkey", "l_linenumber", "track", "sample_id", F.col("payload.module_name").alias("module_name")
    )


SQL["responses_with_samples"] = with_bindings(
    "samples",
    """SELECT l_orderkey, l_linenumber, track, sample_id, module_name FROM lineitem JOIN v_samples ON p_partkey = l_partkey""",
)


def unknown_samples(spark, sf_dir):
    """Sample ids of responses that the dataset does not have."""
    return scoring.unknown_samples(
        bindings.responses(spark, sf_dir), bindings.samples(spark, sf_dir)
    )


SQL["unknown_samples"] = with_bindings(
    "responses samples",
    """SELECT DISTINCT track, sample_id FROM v_responses r
       WHERE NOT EXISTS (SELECT 1 FROM v_samples s WHERE s.track = r.track AND s.sample_id = r.sample_id)""",
)

# --- Prices and usage -----------------------------------------------------------


def price_join(spark, sf_dir):
    """Cost of every call from its tokens and the model's prices."""
    usage = bindings.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "concat('m', l_suppkey) AS model_slug",
        "cast(l_quantity * 5 AS bigint) AS tokens_in", "cast(l_quantity * 10 AS bigint) AS tokens_out",
    )
    return planning.with_cost(usage, bindings.models(spark, sf_dir))


_COST = "tokens_in / 1000000.0::DOUBLE * input_cost_per_mtok + tokens_out / 1000000.0::DOUBLE * output_cost_per_mtok"
_USAGE = """usage AS (SELECT l_orderkey, l_linenumber, l_suppkey, 'm' || CAST(l_suppkey AS VARCHAR) AS model_slug,
  CAST(l_quantity * 5 AS BIGINT) AS tokens_in, CAST(l_quantity * 10 AS BIGINT) AS tokens_out FROM lineitem)"""
SQL["price_join"] = with_bindings(
    "models",
    f"""WITH {_USAGE} SELECT l_orderkey, l_linenumber, model_slug, tokens_in, tokens_out, {_COST} AS cost
        FROM usage LEFT JOIN v_models ON slug = model_slug""",
)


def rounded_usage(spark, sf_dir):
    """Latency at three and cost at six places, as stored on a response row."""
    usage = bindings.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_extendedprice / 7 AS latency_s", "l_extendedprice / 300000 AS cost"
    )
    return usage.withColumns(
        {"latency_s": round_half_even("latency_s", 3), "cost": round_half_even("cost", 6)}
    )


SQL["rounded_usage"] = """
SELECT l_orderkey, l_linenumber, CAST(printf('%.3f', l_extendedprice / 7) AS DOUBLE) AS latency_s,
  CAST(printf('%.6f', l_extendedprice / 300000) AS DOUBLE) AS cost FROM lineitem"""


def prompt_hashes(spark, sf_dir):
    """Short hash of every document taken as a prompt."""
    docs = bindings.table(spark, sf_dir, "documents")
    return docs.select("doc_id", prompting.prompt_hash(F.col("text")).alias("prompt_hash"))


SQL["prompt_hashes"] = "SELECT doc_id, left(sha256(text), 12) AS prompt_hash FROM documents"

# --- Messages -------------------------------------------------------------------


def chat_messages(spark, sf_dir):
    """Ordered messages of each conversation, split by role.

    A conversation fits one model context, so its array is bounded.
    """
    arrays = bindings.messages(spark, sf_dir).groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", "role", "content"))).alias("turns")
    )
    ordered = F.transform("turns", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    split = arrays.select("conv_id", ordered.alias("messages"))
    return split.select(
        "conv_id",
        prompting.system_text(F.col("messages")).alias("system"),
        F.to_json(prompting.chat_turns(F.col("messages"))).alias("turns"),
    )


SQL["chat_messages"] = """
WITH ordered AS (SELECT conv_id, list(struct_pack(role := role, content := text) ORDER BY turn, role, text) AS m FROM conversations GROUP BY conv_id)
SELECT conv_id, array_to_string(list_transform(list_filter(m, lambda x: x.role = 'system'), lambda x: x.content), chr(10)) AS system,
  CAST(to_json(list_filter(m, lambda x: x.role <> 'system')) AS VARCHAR) AS turns FROM ordered"""


def token_estimates(spark, sf_dir):
    """Words per message, summed per conversation."""
    words = prompting.word_count(F.col("content"))
    return bindings.messages(spark, sf_dir).groupBy("conv_id").agg(
        F.sum(words).alias("n_words"), F.count(F.lit(1)).alias("n_messages")
    )


SQL["token_estimates"] = r"""
SELECT conv_id, CAST(sum(len(regexp_extract_all(text, '[^\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))) AS BIGINT) AS n_words,
  count(*) AS n_messages FROM conversations GROUP BY conv_id"""


def request_keys(spark, sf_dir):
    """Request key of each message, and how many messages share it."""
    single = bindings.messages(spark, sf_dir).select(
        F.array(F.struct("role", "content")).alias("messages")
    )
    keyed = single.withColumn("request_key", request_key(F.lit("judge-1"), F.col("messages")))
    return rejudge.distinct_requests(keyed).select("request_key", "n_rows")


SQL["request_keys"] = """
SELECT sha256(CAST(to_json(struct_pack(id := 'judge-1', messages := [struct_pack(role := role, content := text)])) AS VARCHAR)) AS request_key,
  count(*) AS n_rows FROM conversations GROUP BY 1"""


def build_prompts(spark, sf_dir):
    """System and user message of every sample."""
    samples = bindings.samples(spark, sf_dir)
    system = F.concat(F.lit("You work on "), F.col("track"))
    built = prompting.build_messages(system, F.col("track"), F.col("payload"))
    return samples.select("sample_id", "track", F.to_json(built).alias("messages"))


# The wording of the user messages, as the other engine checks it.
SQL["build_prompts"] = with_bindings(
    "samples",
    """WITH users AS (SELECT *, CASE track
         WHEN 'unit_test_gen' THEN 'Module name: `' || module_name || '` — import it as `from ' || module_name || ' import ...`.' || chr(10) || chr(10) || '```python' || chr(10) || source || chr(10) || '```'
         WHEN 'bug_localization' THEN 'Symptom: ' || symptom || chr(10) || chr(10) || 'Code under test (line numbers shown):' || chr(10) || '```' || chr(10) ||
           array_to_string(list_transform(string_split(source, chr(10)), lambda line, i: lpad(CAST(i AS VARCHAR), CAST(greatest(3, len(CAST(i AS VARCHAR))) AS INTEGER), ' ') || '  ' || line), chr(10)) || chr(10) || '```'
         WHEN 'test_case_design' THEN requirement
         WHEN 'e2e_ui' THEN 'Base URL: ' || base_url || chr(10) || chr(10) || 'User flow:' || chr(10) || flow || chr(10) || chr(10) || 'Success condition: ' || success
         WHEN 'e2e_advanced' THEN 'Base URL: ' || base_url || chr(10) || chr(10) || 'Scenario:' || chr(10) || flow || chr(10) || chr(10) || 'Success condition: ' || success
         ELSE 'Base URL: ' || base_url || chr(10) || chr(10) || 'Failing test:' || chr(10) || '```ts' || chr(10) || broken_test || chr(10) || '```' || chr(10) || chr(10) ||
           'Playwright runner output:' || chr(10) || '```' || chr(10) || error || chr(10) || '```' || chr(10) || chr(10) || 'Success condition: ' || success END AS user_text FROM v_samples)
       SELECT sample_id, track, CAST(to_json([struct_pack(role := 'system', content := 'You work on ' || track),
         struct_pack(role := 'user', content := user_text)]) AS VARCHAR) AS messages FROM users""",
)

# --- Attempts -------------------------------------------------------------------


def attempt_rollup(spark, sf_dir):
    """Attempts summed to one response per task, three shots at most."""
    return attempts.roll_up(bindings.attempts(spark, sf_dir), 3)


_KEY = "model_slug, track, sample_id, trial"
SQL["attempt_rollup"] = with_bindings(
    "attempts",
    f"""WITH ends AS (SELECT {_KEY}, least(coalesce(min(CASE WHEN passed OR error <> '' THEN attempt END), 3), 3) AS last_attempt FROM v_attempts GROUP BY ALL),
        kept AS (SELECT a.* FROM v_attempts a JOIN ends USING ({_KEY}) WHERE attempt <= last_attempt)
        SELECT {_KEY}, max(attempt) AS attempts,
          CAST(coalesce(sum(tokens_in) FILTER (error = ''), 0) AS BIGINT) AS tokens_in, CAST(coalesce(sum(tokens_out) FILTER (error = ''), 0) AS BIGINT) AS tokens_out,
          CAST(printf('%.3f', coalesce(sum(latency_s) FILTER (error = ''), 0)) AS DOUBLE) AS latency_s,
          CAST(printf('%.6f', coalesce(sum(cost) FILTER (error = ''), 0)) AS DOUBLE) AS cost,
          arg_max(error, attempt) AS error, coalesce(arg_max(raw_output, attempt) FILTER (error = ''), '') AS raw_output
        FROM kept GROUP BY ALL""",
)


def first_passing_attempt(spark, sf_dir):
    """The attempt each task ends on."""
    return attempts.last_attempts(bindings.attempts(spark, sf_dir), 3).withColumnRenamed(
        "_last", "last_attempt"
    )


SQL["first_passing_attempt"] = with_bindings(
    "attempts",
    f"""SELECT {_KEY}, least(coalesce(min(CASE WHEN passed OR error <> '' THEN attempt END), 3), 3) AS last_attempt
        FROM v_attempts GROUP BY ALL""",
)


def next_round(spark, sf_dir):
    """Requests of the next round with the failed output and its feedback."""
    rows = bindings.attempts(spark, sf_dir).withColumn(
        "messages",
        F.array(F.struct(F.lit("user").alias("role"), F.col("sample_id").alias("content"))),
    )
    due = attempts.next_requests(rows, 3)
    return due.withColumn("messages", F.to_json("messages"))


SQL["next_round"] = with_bindings(
    "attempts",
    f"""SELECT {_KEY}, attempt + 1 AS attempt, CAST(to_json([struct_pack(role := 'user', content := sample_id),
          struct_pack(role := 'assistant', content := raw_output),
          struct_pack(role := 'user', content := 'Your attempt did not pass. ' || feedback || ' Try again.')]) AS VARCHAR) AS messages
        FROM v_attempts WHERE NOT passed AND error = '' AND attempt < 3""",
)

for _fn in (
    select_default_models, select_listed_models, model_labels, unknown_models, select_tracks,
    headline_rows, first_samples, plan_tasks, planned_rows, plan_limited_tasks, total_tasks, resume_tasks,
    pending_responses, base_projection, responses_with_samples, unknown_samples, price_join,
    rounded_usage, prompt_hashes, chat_messages, token_estimates, request_keys, build_prompts,
    attempt_rollup, first_passing_attempt, next_round,
):
    QUERIES[_fn.__name__] = _fn
