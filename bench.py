"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the folder of the given tables, BENCH_CPUS the local cores.
"""

import json
import os
import sys
import time

from tramline.plans.queries import QUERIES
from tramline.session import local_session

HEADLINE = (
    "active_services",
    "trip_instances",
    "stop_events",
    "gold_analysis_days",
    "gold_route_daily",
    "gold_stop_daily",
    "gold_route_stop_hourly",
    "gold_route_stop_headways",
    "gold_service_span",
    "coverage_daily",
    "publish_gold",
    "overview_kpi",
    "group_daily",
    "trip_patterns",
    "stop_departures",
    "silver_stop_times",
    "dq_report",
    "normalize_positions",
)


def main():
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    QUERIES["active_services"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        try:
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        except Exception as error:  # the other queries are timed all the same
            print(f"{name}: {type(error).__name__}: {str(error)[:500]}", file=sys.stderr, flush=True)
            continue
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name}: {seconds[name]} s", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall-clock",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
