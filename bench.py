"""Headline queries on local cores; prints one JSON line.

Each query runs once to warm up and three times for the median, forced with the
``noop`` writer so that every column is computed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketlens.plans.catalog import REGISTRY  # noqa: E402
from basketlens.plans.session import local_session  # noqa: E402

HEADLINE = [
    "monthly_overview",
    "customer_profile",
    "rfm_scores",
    "rfm_summary",
    "funnel_by_device",
    "geography",
    "retention_orders",
    "category_monthly",
    "category_performance",
    "top_products",
    "review_sentiment",
    "category_keywords",
    "kpis",
    "business_snapshot",
    "standardised_features",
    "silhouette_exact",
    "silhouette_squared",
    "category_phrases",
    "customer_clusters",
]


def timed(run) -> float:
    start = time.perf_counter()
    run().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus)
    times: dict[str, float] = {}
    for name in names:
        def run(q=REGISTRY[name]):
            return q(spark, folder)

        timed(run)
        times[name] = round(statistics.median(timed(run) for _ in range(3)), 3)
    total = round(sum(times.values()), 3)
    sf = folder.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": total, "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
