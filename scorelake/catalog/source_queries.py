"""Sources, sinks and incremental runs: tables written and read back.

Everything is written to a new folder below the shared folder of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scorelake import fixed_values as fixed
from scorelake import schemas
from scorelake.catalog import bindings, metric_sql
from scorelake.catalog.bindings import with_bindings
from scorelake.functions.prompting import prompt_hash
from scorelake.operators import compare, metrics, summary
from scorelake.plans import scoring
from scorelake.sources import facts, registry, summaries
from scorelake.sources.workspace import new_folder
from scorelake.sources.versions import Versions
from scorelake.streaming import incremental

QUERIES: dict = {}
SQL: dict[str, str] = {}
_KEY = ", ".join(fixed.KEY_COLUMNS)

_RESPONSE_COLUMNS = schemas.RESPONSES.fieldNames()

# --- Facts ----------------------------------------------------------------------


def jsonl_facts(spark, sf_dir):
    """Responses appended to JSON lines in two parts and read back."""
    path = new_folder(spark, "responses")
    rows = bindings.responses(spark, sf_dir).select(*_RESPONSE_COLUMNS)
    facts.append_jsonl(rows.filter("track < 'e'"), path)
    facts.append_jsonl(rows.filter("track >= 'e'"), path)
    return facts.read_jsonl(spark, path, schemas.RESPONSES).drop(facts.CORRUPT)


SQL["jsonl_facts"] = with_bindings(
    "responses", f"SELECT {', '.join(_RESPONSE_COLUMNS)} FROM v_responses"
)


def sparse_rewrite(spark, sf_dir):
    """Scored rows written without empty fields and read back with the declared schema."""
    path = new_folder(spark, "scored")
    rows = bindings.scored(spark, sf_dir)
    facts.write_sparse(rows, path)
    back = facts.read_jsonl(spark, path, schemas.SCORED)
    return back.select(*rows.columns)


_SCORED_COLUMNS = ["model_slug", "track", "sample_id", "trial", *(n for n, _, _ in bindings._SCORED_COLUMNS)]
SQL["sparse_rewrite"] = with_bindings("scored", f"SELECT {', '.join(_SCORED_COLUMNS)} FROM v_scored")


def run_partitions(spark, sf_dir):
    """One run and track of facts partitioned by both."""
    path = new_folder(spark, "facts")
    rows = bindings.scored(spark, sf_dir).select(*fixed.KEY_COLUMNS, "tokens_out", "passed")
    by_run = rows.withColumn("run_id", F.concat(F.lit("run-"), F.col("trial").cast("string")))
    facts.write_partitioned(by_run, path)
    return facts.read_run(spark, path, "run-1", "e2e_ui")


SQL["run_partitions"] = with_bindings(
    "scored",
    f"SELECT {_KEY}, tokens_out, passed, 'run-1' AS run_id FROM v_scored WHERE trial = 1 AND track = 'e2e_ui'",
)

# --- Summaries ------------------------------------------------------------------


def _rounded(spark, sf_dir, rows: str = "true") -> DataFrame:
    return summary.summarize(bindings.scored(spark, sf_dir).filter(rows))


_ROUNDED = ", ".join(
    f"{metric_sql.python_round(c)} AS {c}" if c in (*metrics.METRICS, "composite_std") else c
    for c in ("model_slug", "track", "n_samples", "n_trials", *metrics.METRICS, "composite_std", "tier")
)


def csv_summary(spark, sf_dir):
    """The summary written as CSV and read back."""
    path = new_folder(spark, "summary")
    summaries.write_summary(_rounded(spark, sf_dir), path)
    return summaries.read_summary(spark, path)


SQL["csv_summary"] = with_bindings(
    "scored", f"WITH {metric_sql.SUMMARY.strip()} SELECT {_ROUNDED} FROM summary"
)


def list_runs(spark, sf_dir):
    """Runs below a folder, newest first, with the number of their rows."""
    root = new_folder(spark, "runs")
    scored = bindings.scored(spark, sf_dir)
    for run_id, rows in (("old run", "trial = 0"), ("a+new%run", "trial > 0")):
        table = summary.summarize(scored.filter(rows))
        if run_id == "old run":
            # Its columns lie in another order, one is missing and one is of its own.
            names = [c for c in reversed(table.columns) if c != "tier"]
            table = table.select(F.lit("x").alias("mood"), *names)
        summaries.write_summary(table, f"{root}/{run_id}/summary.csv")
    found = summaries.read_all_summaries(spark, root)
    listed = summaries.list_runs(found)
    place = F.row_number().over(W.orderBy(F.desc("run_mtime"), F.desc("run_id")))  # a row per run
    order = listed.select("run_id", place.cast("long").alias("place"), F.col("run_mtime").isNotNull().alias("dated"))
    sizes = found.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("tier").alias("n_tiers"), F.sum("n_samples").alias("n_samples")
    )
    return order.join(sizes, "run_id")


SQL["list_runs"] = with_bindings(
    "scored",
    """WITH runs AS (SELECT *, CASE WHEN trial = 0 THEN 'old run' ELSE 'a+new%run' END AS run_id FROM v_scored),
       leveled AS (SELECT run_id, model_slug, track, sample_id FROM runs UNION ALL SELECT run_id, model_slug, 'ALL', sample_id FROM runs),
       sizes AS (SELECT run_id, model_slug, track, count(DISTINCT sample_id) AS n FROM leveled GROUP BY ALL)
       SELECT run_id, CAST(CASE WHEN run_id = 'old run' THEN 2 ELSE 1 END AS BIGINT) AS place, true AS dated, count(*) AS n_rows,
         CASE WHEN run_id = 'old run' THEN 0 ELSE count(*) END AS n_tiers, CAST(sum(n) AS BIGINT) AS n_samples FROM sizes GROUP BY run_id""",
)


def one_run(spark, sf_dir):
    """The summary of one run out of a folder of runs."""
    root = new_folder(spark, "runs")
    for run_id, rows in (("a", "trial = 0"), ("b", "trial > 0")):
        summaries.write_summary(_rounded(spark, sf_dir, rows), f"{root}/{run_id}/summary.csv")
    both = summaries.read_all_summaries(spark, root)
    return summaries.of_run(both, "b").select("run_id", "model_slug", "track", "recall", "tier")


SQL["one_run"] = with_bindings(
    "scored",
    f"""WITH late AS (SELECT * FROM v_scored WHERE trial > 0), {metric_sql.summary_ctes("late").strip()}
        SELECT 'b' AS run_id, model_slug, track, {metric_sql.python_round('recall')} AS recall, tier FROM summary""",
)


def report_files(spark, sf_dir):
    """Report tables written one folder per track and read back."""
    path = new_folder(spark, "report")
    tables = compare.report_tables(_rounded(spark, sf_dir))
    summaries.write_report(tables, path)
    back = spark.read.schema(tables.schema).option("header", True).csv(path)
    return back.select("track", "position", "model_slug", "tier", "recall", "n_trials")


SQL["report_files"] = with_bindings(
    "scored",
    f"""WITH {metric_sql.SUMMARY.strip()}, shown AS (SELECT {_ROUNDED} FROM summary)
        SELECT track, row_number() OVER (PARTITION BY track ORDER BY composite DESC NULLS LAST, model_slug) AS position, model_slug, tier, recall, n_trials FROM shown""",
)


def manifest_report(spark, sf_dir):
    """Report tables of two runs, each headed by its own manifest, which is written and read back."""
    path = new_folder(spark, "manifests")
    for run, judge, shots in (("r1", "judge-1", 3), ("r2", "judge-2", 1)):
        registry.write_manifest(registry.manifest(spark, {"run_id": run, "judge_model": judge, "shots": shots, "tracks": ["e2e_ui"]}), f"{path}/{run}")
    heads = registry.read_manifest(spark, f"{path}/*")
    runs = _rounded(spark, sf_dir).withColumn("run_id", F.explode(F.array(F.lit("r1"), F.lit("r2"), F.lit("r3"))))
    tables = compare.report_tables(runs, heads)
    return tables.select("run_id", "track", "position", "model_slug", "run.judge_model", "run.shots", F.element_at("run.tracks", 1).alias("first_track"))


SQL["manifest_report"] = with_bindings(
    "scored",
    f"""WITH {metric_sql.SUMMARY.strip()}, shown AS (SELECT {_ROUNDED} FROM summary), heads AS (
          SELECT * FROM (VALUES ('r1', 'judge-1', 3, 'e2e_ui'), ('r2', 'judge-2', 1, 'e2e_ui'), ('r3', NULL, NULL, NULL)) AS h(run_id, judge_model, shots, first_track))
        SELECT run_id, track, row_number() OVER (PARTITION BY run_id, track ORDER BY composite DESC NULLS LAST, model_slug) AS position, model_slug,
          judge_model, CAST(shots AS INTEGER) AS shots, first_track FROM shown, heads""",
)


def run_manifest(spark, sf_dir):
    """A manifest with the planned total and prompt hashes, written and read back."""
    path = new_folder(spark, "manifest")
    scored = bindings.scored(spark, sf_dir)
    hashes = scored.select("track").distinct().select("track", prompt_hash(F.col("track")).alias("hash"))
    # At most one row per track of the registry.
    listed = hashes.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("track", "hash")))).alias("m"))
    total = scored.agg(F.count(F.lit(1)).alias("n"))
    fields = {"run_id": "r1", "shots": 3, "trials": 2, "temperature": 1.0, "judge_model": "judge-1",
              "tracks": list(fixed.TRACK_NAMES), "models": []}
    row = registry.manifest(spark, fields).withColumns(
        {"total_tasks": total.scalar(), "prompt_hashes": listed.scalar()}
    )
    registry.write_manifest(row, path)
    return registry.read_manifest(spark, path).select(
        "run_id", "shots", "trials", "judge_model", "total_tasks", F.explode("prompt_hashes").alias("track", "prompt_hash")
    )


SQL["run_manifest"] = with_bindings(
    "scored",
    """SELECT 'r1' AS run_id, CAST(3 AS INTEGER) AS shots, CAST(2 AS INTEGER) AS trials, 'judge-1' AS judge_model,
         (SELECT count(*) FROM v_scored) AS total_tasks, track, left(sha256(track), 12) AS prompt_hash
       FROM (SELECT DISTINCT track FROM v_scored)""",
)

# --- Incremental runs -----------------------------------------------------------

# Three deliveries that together hold every response, in order of arrival.
_DELIVERIES = ("l_linenumber <= 2", "l_linenumber BETWEEN 3 AND 4", "l_linenumber >= 5")
_ARRIVAL = "arrival"


def _deliveries(spark, sf_dir) -> list[DataFrame]:
    arrived = bindings.scored(spark, sf_dir, extra=("l_linenumber", bindings.ARRIVAL))
    return [arrived.filter(rows).drop("l_linenumber") for rows in _DELIVERIES]


def _followed(spark, sf_dir) -> tuple[incremental.Tables, list[str]]:
    """Deliver three times and follow after each delivery."""
    root = new_folder(spark, "incremental")
    tables = incremental.Tables(f"{root}/tables")
    columns: list[str] = []
    for rows in _deliveries(spark, sf_dir):
        rows.write.mode("append").parquet(f"{root}/inbox")
        columns = [c for c in rows.columns if c != _ARRIVAL]
        incremental.follow(
            spark, f"{root}/inbox", rows.schema, tables, lambda new: new.drop(_ARRIVAL), _ARRIVAL, "parquet"
        )
    return tables, columns


_FIRST = f"""first_rows AS (SELECT * EXCLUDE (arrival, l_linenumber) FROM v_arrived
  QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY CASE WHEN l_linenumber <= 2 THEN 0 WHEN l_linenumber <= 4 THEN 1 ELSE 2 END, arrival) = 1)"""


def unique_keys(spark, sf_dir):
    """Keys seen by the incremental run and how often each was kept."""
    tables, _ = _followed(spark, sf_dir)
    return incremental.scored_so_far(spark, tables).groupBy(*fixed.KEY_COLUMNS).agg(
        F.count(F.lit(1)).alias("n_rows")
    )


SQL["unique_keys"] = with_bindings("scored", f"SELECT DISTINCT {_KEY}, CAST(1 AS BIGINT) AS n_rows FROM v_scored")


def running_summary(spark, sf_dir):
    """The summary out of three micro-batches' statistics."""
    tables, columns = _followed(spark, sf_dir)
    rows = incremental.running_summary(spark, tables, columns, rounded=False)
    return rows.withColumns({c: F.round(c, 10) for c in ("composite", "composite_std")})


_TEN = ", ".join(
    f"round({c}, 10) AS {c}" if c.startswith("composite") else c
    for c in ("model_slug", "track", "n_samples", "n_trials", *metrics.METRICS, "composite_std", "tier")
)
SQL["running_summary"] = with_bindings(
    "arrived", f"WITH {_FIRST}, {metric_sql.summary_ctes('first_rows').strip()} SELECT {_TEN} FROM summary"
)


def rescored_rows(spark, sf_dir):
    """Everything scored again into a new folder after some rows were removed."""
    path = new_folder(spark, "rescored")
    kept = bindings.scored(spark, sf_dir, extra=(bindings.ARRIVAL,)).filter("attempts < 3")
    incremental.rescore(kept, lambda rows: rows.drop(_ARRIVAL), _ARRIVAL, path)
    return spark.read.parquet(path).groupBy("track").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("tokens_out").alias("tokens_out")
    )


SQL["rescored_rows"] = with_bindings(
    "arrived",
    f"""WITH kept AS (SELECT * FROM v_arrived WHERE attempts < 3 QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY arrival) = 1)
        SELECT track, count(*) AS n_rows, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM kept GROUP BY 1""",
)

def versioned_rewrite(spark, sf_dir):
    """Sparse rows replaced twice: a reader from before the swaps, and the current version after them."""
    table = Versions(spark, new_folder(spark, "versions"))
    arrived = bindings.scored(spark, sf_dir, extra=(bindings.ARRIVAL,))

    def current() -> DataFrame:
        return facts.read_jsonl(spark, table.folder(), schemas.SCORED)

    def counted(rows: DataFrame, label: str) -> DataFrame:
        counts = rows.groupBy("track").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tokens_out").alias("tokens_out"))
        return counts.withColumn("version", F.lit(label))

    table.replace(incremental.first_arrivals(arrived, _ARRIVAL).drop(_ARRIVAL), facts.write_sparse)
    before = counted(current(), "first")
    table.replace(current().where("attempts < 3"), facts.write_sparse)
    middle = counted(current(), "removed")
    # Responses that are gone are not scored again; others of their key are.
    incremental.rescore_version(arrived.where("attempts < 3"), lambda rows: rows.drop(_ARRIVAL), _ARRIVAL, table, facts.write_sparse)
    return before.unionByName(middle).unionByName(counted(current(), "rescored"))


SQL["versioned_rewrite"] = with_bindings(
    "arrived",
    f"""WITH first AS (SELECT * FROM v_arrived QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY arrival) = 1),
          kept AS (SELECT * FROM v_arrived WHERE attempts < 3 QUALIFY row_number() OVER (PARTITION BY {_KEY} ORDER BY arrival) = 1),
          all_rows AS (SELECT 'first' AS version, track, tokens_out FROM first UNION ALL
            SELECT 'removed', track, tokens_out FROM first WHERE attempts < 3 UNION ALL SELECT 'rescored', track, tokens_out FROM kept)
        SELECT version, track, count(*) AS n_rows, CAST(sum(tokens_out) AS BIGINT) AS tokens_out FROM all_rows GROUP BY 1, 2""",
)


def unique_stream_keys(spark, sf_dir):
    """Keys of a stream of deliveries, each let through once."""
    root = new_folder(spark, "stream")
    for rows in _deliveries(spark, sf_dir):
        rows.select(*fixed.KEY_COLUMNS).write.mode("append").parquet(f"{root}/inbox")
    schema = spark.read.parquet(f"{root}/inbox").schema
    stream = incremental.unique_stream(spark.readStream.schema(schema).parquet(f"{root}/inbox"))
    incremental.append_unique(stream, f"{root}/out", f"{root}/progress")
    return spark.read.schema(schema).parquet(f"{root}/out").groupBy(*fixed.KEY_COLUMNS).agg(F.count(F.lit(1)).alias("n_rows"))


SQL["unique_stream_keys"] = SQL["unique_keys"]

# Three deliveries of events: some of the first days' come so late that they are dropped,
# and some of each delivery's last days come again in the next one.
_LATE = "day <= 5 AND event_id % 7 = 0"
_EVENT_DELIVERIES = (
    f"day <= 10 AND NOT ({_LATE})",
    "day BETWEEN 11 AND 20 OR (day = 10 AND event_id % 3 = 0)",
    f"day > 20 OR (day = 20 AND event_id % 3 = 0) OR ({_LATE})",
)


def unique_events(spark, sf_dir):
    """Events per day out of a stream that drops repeats and late rows, and the keys its state still holds."""
    root, held = new_folder(spark, "events"), 0
    second = F.date_trunc("second", "ts")
    events = bindings.table(spark, sf_dir, "events").select("event_id", second.alias("ts"), F.dayofmonth("ts").alias("day"))
    for rows in _EVENT_DELIVERIES:
        events.where(rows).write.mode("append").parquet(f"{root}/inbox")
        stream = spark.readStream.schema(events.schema).parquet(f"{root}/inbox")
        held = incremental.append_unique(
            incremental.unique_stream(stream, "ts", "2 days", ("event_id",)), f"{root}/out", f"{root}/progress"
        )
    out = spark.read.schema(events.schema).parquet(f"{root}/out")
    return out.groupBy("day").agg(F.count(F.lit(1)).alias("n_events"), F.lit(held).cast("long").alias("state_rows"))


SQL["unique_events"] = """
WITH e AS (SELECT event_id, date_trunc('second', ts) AS ts, CAST(day(ts) AS INTEGER) AS day FROM events),
     kept AS (SELECT * FROM e WHERE NOT (day <= 5 AND event_id % 7 = 0))
SELECT day, count(*) AS n_events,
  (SELECT count(*) FROM kept WHERE ts > (SELECT max(ts) FROM e) - INTERVAL 4 DAY) AS state_rows
FROM kept GROUP BY day"""

for _fn in (
    unique_stream_keys, unique_events, versioned_rewrite, jsonl_facts, sparse_rewrite, run_partitions, csv_summary, list_runs, one_run, report_files, manifest_report,
    run_manifest, unique_keys, running_summary, rescored_rows,
):
    QUERIES[_fn.__name__] = _fn
