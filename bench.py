"""Times the headline jobs once each, after a warm-up, and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "spend_by_category",
    "dashboard_totals",
    "totals_by_user",
    "top_vendors",
    "top_vendors_by_business",
    "days_of_month",
    "logged_list",
    "accountant_lines",
    "scope_month_category",
    "duplicate_gate",
    "canonical_vendors",
    "extracted_bills",
    "threshold_sweep",
    "tax_quarters",
    "daily_summary",
    "garbage_texts",
    "draft_replay",
    "undo_requests",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from paperledger.plans.queries import QUERIES

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("paperledger-bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        # The text rules are CPU-bound: small partitions keep every core busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["spend_by_category"](spark, folder).count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_seconds", "value": total, "unit": "sec", "queries": times, "sf": folder.rsplit("sf", 1)[-1].strip("/")}))


if __name__ == "__main__":
    main()
