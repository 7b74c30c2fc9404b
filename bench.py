"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Every query
runs to a sink that takes all rows and columns; the best of ``BENCH_RUNS`` runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

from servicenight.plans import catalog
from servicenight.session import build_session

HEADLINE = [
    "stage_orders", "stage_items", "order_seating", "order_facts", "menu_item_dimension", "item_facts",
    "nightly_summary", "mean_revenue_by_hour", "same_month_comparison", "trend_regular_month",
    "category_mix", "top_items", "like_for_like_prices", "turn_gaps", "gap_by_fullness",
    "occupancy_timeline", "room_fullness", "utilization_by_slot", "best_blocks", "shrinkage_summary",
    "merge_pulls", "pull_supersession", "export_records",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
                          spark__driver__memory=os.environ.get("BENCH_MEMORY", "8g"),
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    queries, seconds = catalog.queries(), {}
    for name in wanted:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
                      "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
