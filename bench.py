"""Wall time of the headline queries, each written out in full three times, the middle one counts; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [query ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stallwise.plans import QUERIES  # noqa: E402
from stallwise.session import build_session  # noqa: E402

HEADLINES = (
    "listing_page", "search_text", "priced_listing", "sort_popular", "facet_rollup", "product_detail", "top_reviews",
    "price_cart", "order_totals", "place_orders", "order_message", "order_count_rollup", "bag_totals",
    "traffic_series", "traffic_summary", "top_referrers", "distinct_visitors", "throttled_views",
    "throttled_views_by_visitor", "review_queue", "approve_reviews", "rating_rollup", "shop_stats", "bulk_validate",
    "bulk_apply", "full_update", "create_products", "unique_slugs", "slugify", "stream_hits", "stream_throttled_views",
)


RUNS = 3


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", app="bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # the engine's own start-up is not part of any query
    for name in ("sort_newest", "facet_collections"):
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times: dict[str, float] = {}
    for name in names or HEADLINES:
        took = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took.append(time.perf_counter() - start)
        times[name] = round(sorted(took)[RUNS // 2], 3)
        print(f"{name:28s} {times[name]:7.2f}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
