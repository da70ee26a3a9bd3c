"""Benchmark of the headline queries: one JSON line with seconds per query.

Every query is run to the end with a no-op sink; the time is the median of
``BENCH_RUNS`` runs after one warm-up.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from martspark.registry import QUERIES
from martspark.session import local_session

HEADLINE = [
    "a08_executive_kpis", "w01_daily_demand", "w08_product_performance", "a03_customer_rfm",
    "a04_user_product_interactions", "a09_store_dimension", "m01_item_features", "q01_kpi_summary",
    "q03_inventory_status", "q04_weekly_totals", "r01_enriched_feed", "r02_inventory_alerts", "r09_latency_quantiles",
    "r12_rate_limited", "p08_clean_invoices", "p04_stg_products", "j02_priced_sales", "e02_describe_revenue",
    "d06_suite_mart_executive_kpis", "m17_similar_items", "a15_product_lookup",
    "m01_sparse_features", "m17_bucketed_items", "m08_fixed_weights", "r04_streamed_enriched",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, "bench", shuffle_partitions=int(cores) if cores.isdigit() else 8)
    seconds = {}
    for name in HEADLINE:
        times = []
        for attempt in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if attempt:
                times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
