"""Times the headline queries and prints one JSON line.

Each query runs twice, writing to Spark's no-op sink so that every row is computed;
the faster run counts, which leaves out class loading and code generation.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from scorelake.catalog import all_queries  # noqa: E402
from scorelake.session import configured  # noqa: E402

HEADLINE = (
    "summarize",
    "leaderboard",
    "latest_per_model",
    "pattern_matrix",
    "text_job",
    "page_lexing",
    "score_responses",
    "refresh_judgements",
    "plan_tasks",
    "pending_responses",
    "attempt_rollup",
    "event_rank_correlation",
    "leak_scan",
    "jsonl_facts",
)
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("bench")
    spark = (
        configured(builder)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    chosen = sys.argv[1:] or HEADLINE
    seconds: dict[str, float] = {}
    for name in chosen:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
