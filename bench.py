"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON.

Each query runs once to warm up and then RUNS times; its figure is the median. Results are written to the no-op sink, so
nothing is skipped and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from weirstone.plans import catalog

RUNS = 3
HEADLINE = (
    "q1_pricing_summary",
    "q6_revenue",
    "q6_revenue_wide",
    "tumbling_sum_keyed",
    "tumbling_count_keyed",
    "sliding_sum",
    "session_sum",
    "late_on_time",
    "key_hash",
    "etl_report",
    "fulfillment_invoice",
    "order_settlement",
    "scale_round",
    "sha3_udf",
    "sql_passthrough",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        took = []
        for _ in range(1 + RUNS):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - began)
        seconds[name] = round(statistics.median(took[1:]), 4)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rsplit("sf", 1)[-1], "cpus": int(cpus)}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
