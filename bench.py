"""Headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then $BENCH_RUNS times (3); the median
counts. Results go to the no-op sink, so every row and column is computed.
"""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dwellframe.plans import load_all  # noqa: E402
from dwellframe.session import local_session  # noqa: E402

HEADLINE = [
    "district_top20", "overview", "district_detail", "total_price_hist", "top_communities", "quick_stats",
    "daily_log_stats", "search_filters", "search_page", "nearest_topk", "price_repair", "dedupe_cross_file",
    "dedupe_fingerprint", "missing_profile", "enrich_fill_missing", "upsert_v1", "mark_stale", "page_links",
    "page_overlap", "features", "frequent_itemsets", "cluster_profile", "regression_metrics", "quota",
    "rules", "synthetic_rows", "stream_upsert",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session("dwellframe-bench", cpus, partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    times = {}
    for name in HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registry[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": int(cpus), "runs": runs,
        "driver_memory": spark.conf.get("spark.driver.memory", None),
        "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}))


if __name__ == "__main__":
    main()
