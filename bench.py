"""Times the headline queries at ``$BENCH_SF_DIR`` and prints one JSON line.

``BENCH_QUERIES`` (comma separated names, or ``all``) picks other queries.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "merge_sightings_trade", "merge_sightings_events", "window_counts_trade", "weighted_median_popcount",
    "coverage_grades_nations", "origin_breakdown", "server_overlap", "multi_window_report", "representative_posts",
    "minute_rollup", "tag_overview", "tag_overview_expanded", "load_candidates", "cap_candidate_writes",
    "upsert_observations", "upsert_candidates", "rank_trending", "assign_tiers", "discovery_pass", "poll_plan",
    "fold_health", "health_summary", "normalise_statuses", "clean_candidates", "evaluate_report", "check_claims",
    "tag_report", "explore_report", "stream_minute_counts", "stream_collection", "parse_only",
]


def parse_only(spark, sf: str):
    """Parsing and normalising by itself: the captured pages are built and stored before the clock starts."""
    from tagtide.operators import ingest
    from tagtide.session import fresh_folder
    from tagtide.sources import raw
    from workload import bindings as B
    from workload.posts import captured_pages

    folder = fresh_folder(spark, "pages")
    captured_pages(spark, sf).write.parquet(folder)
    statuses = raw.parse_statuses(spark.read.parquet(folder)).withColumnRenamed("server", "host").withColumnRenamed("batch_at", "observed_at")
    return ingest.normalise(statuses, B.SALT)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")

    from tagtide import build_session
    from workload.catalog import load

    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-shared-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    checks = load()
    names = list(checks) if chosen == "all" else chosen.split(",") if chosen else HEADLINE

    def run(name: str) -> float:
        if name == "parse_only":
            df = parse_only(spark, sf)
            start = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            return time.perf_counter() - start
        start = time.perf_counter()
        checks[name][0](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run(names[0])  # the JVM warms up outside the clock
    seconds = {}
    for name in names:
        seconds[name] = round(run(name), 3)
        print(f"{seconds[name]:8.2f}  {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
