"""Times the registered queries and prints one JSON line.

BENCH_SF_DIR: data folder, BENCH_CPUS: local cores, BENCH_RUNS: warm runs per
query (the median counts), BENCH_KEYS: comma-separated choice of queries.
"""

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lakewright.catalogue import query_functions  # noqa: E402
from lakewright.session import build_session  # noqa: E402

HEADLINE = (
    "ingest_orders", "run_tests", "test_unique", "test_relationships", "quarantine", "staged_read",
    "uncastable_report", "dedupe_on_key", "merge_to_source", "scd2_snapshot", "transition_check", "latest_stage",
    "stage_summary", "failure_alert", "cluster_layout", "layered_settings", "mirror_plan", "mirror_missing_dirs",
    "new_tables", "scheduled_sync", "log_routing", "reference_lookup", "entity_upsert", "project_outputs",
    "rewrite_nested", "propagate", "materialise_model", "table_documentation", "append_to_source",
    "stream_ingest", "stream_failure_alert",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    keys = os.environ.get("BENCH_KEYS")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    functions, times = query_functions(), {}
    for name in keys.split(",") if keys else HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            # Every column of every row is computed, nothing is fetched.
            functions[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": Path(folder).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
