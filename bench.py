"""Time the headline queries and print one JSON line.

Reads BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS].  Each
query is run once to warm up and then BENCH_RUNS times (default 3); the median
counts.  Results go to the ``noop`` sink, so every row is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tiffin.catalog import QUERIES
from tiffin.session import build_session

HEADLINE = (
    "orders_with_discounts", "orders_by_category", "price_levels", "order_costs",
    "q_line_restaurant", "q_discount_cap", "admit_applications", "loyalty_points",
    "restaurant_categories", "q_key", "q_check_all", "add_items", "update_items",
    "cascade_delete", "stream_order_cost", "stream_admission",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session("tiffin-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(f"{name} {[round(t, 2) for t in taken]}", file=sys.stderr)
    print(json.dumps({"metric": "total_warm_median", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
