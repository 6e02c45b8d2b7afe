"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from runledger import queries, session  # noqa: E402

HEADLINE = [
    "job_health",
    "job_health_30d",
    "health_summary",
    "job_details",
    "duration_stats",
    "job_costs",
    "team_costs",
    "cost_anomalies",
    "alerts",
    "cluster_utilization",
    "trend_cost",
    "trend_success",
    "trend_failures",
    "recent_runs_by_job",
    "row_count_delta",
    "schema_drift",
    "apply_presets",
    "dashboard",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        f"local[{cpus}]",
        name="bench",
        spark__sql__shuffle__partitions=cpus,
        spark__driver__memory="8g",
        spark__ui__enabled="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").count()
    times = {}
    for name in os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE:
        run = queries.query(name)
        best = None
        for _ in range(int(os.environ.get("BENCH_REPEATS", "2"))):
            started = time.perf_counter()
            run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
    spark.stop()
    total = round(sum(times.values()), 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": scale}))


if __name__ == "__main__":
    main()
