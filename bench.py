"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the data, BENCH_CPUS (default 8) the cores.
Each query is written to the no-op sink, so every row and column is computed. A query runs once to warm
up, then three times (BENCH_RUNS); the median counts. Intermediate results go to a fresh folder of
the run, named to the session, and are removed after each query.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import SparkSession

from logloom.plans.catalog import QUERIES, run
from logloom.session import stage_scope

HEADLINE = (
    "search_newest",
    "search_after_page",
    "phrase_filter",
    "count_capped",
    "app_counts",
    "source_counts",
    "severity_counts",
    "error_figures",
    "worst_hosts",
    "facet_lists",
    "apps_per_host",
    "resolved_aliases",
    "drop_rule_matches",
    "alert_rule_matches",
    "threshold_windows",
    "firing_seconds",
    "alert_backtest",
    "rule_coverage_report",
    "session_drops",
    "silenced_incidents",
    "rows_around",
    "rows_of_incidents",
    "review_bundles",
    "digests_per_day",
    "prune_counts",
    "word_index",
    "index_phrase",
    "assembled_entries",
    "parsed_syslog",
    "container_rows",
    "json_records",
    "redacted_documents",
    "words_per_language",
    "places_and_sums",
)


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-", dir="/tmp"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    run("severity_counts", spark, sf_dir).count()  # starts the engine
    times: dict[str, float] = {}
    for name in HEADLINE:
        taken = []
        for _ in range(1 + int(os.environ.get("BENCH_RUNS", "3"))):
            start = time.perf_counter()
            with stage_scope():
                run(name, spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:] or taken), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf_dir,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    assert set(HEADLINE) <= set(QUERIES)
    main()
