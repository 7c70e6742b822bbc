"""Time the headline queries at one scale and print a single JSON line.

``BENCH_SF_DIR`` is the folder of parquet tables, ``BENCH_CPUS`` the number of
local cores, ``BENCH_REPEATS`` the number of timed runs after one warm-up (the median counts).
Results are forced with a no-op write, so nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from shopledger.registry import run  # noqa: E402

HEADLINE = (
    "net_sales", "net_sales_cost_adjusted", "to_date_buckets", "pareto", "lifecycle_rolling", "dense_grid",
    "customer_frequency_and_spend", "customer_segmentation_channel_month",
    "customer_segmentation_channel_product_quarter", "top_customers", "online_cooking_class_buyers",
    "sales_by_price_type", "store_daily_kpis", "market_basket_report", "open_backorders_report",
    "open_purchase_orders", "sales_and_inventory", "returns_by_store", "sales_by_discount_code", "store_margin",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "7g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        runs = []
        for attempt in range(repeats + 1):
            start = time.perf_counter()
            run(name, spark, folder).write.format("noop").mode("overwrite").save()
            if attempt or not repeats:
                runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs), 3)
        print(f"{name:48s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
