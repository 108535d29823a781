"""Times the queries at one scale and prints one JSON line.

Each query runs to the end with its rows thrown away. One untimed run of the
flagship warms the session; ``value`` is the sum over the headline queries.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from curbside.plans.queries import REGISTRY  # noqa: E402
from curbside.session import build_session  # noqa: E402

HEADLINE = [
    "price_by_location", "to_listing", "validate", "housing_info_split", "dedup_url", "first_seen",
    "dedup_similar_exact", "dedup_similar_fuzzy", "cap_per_location", "extract_nav_links",
    "extract_search_rows", "extract_details", "join_details", "page_yield", "payload_normalize",
    "post_text_fallback", "extract_posts", "snapshot_yield", "truncate_stale", "quota_ledger",
    "listings_from_pages", "listings_from_payloads", "posts_from_snapshots",
    "stream_listings", "stream_posts", "stream_quota",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
           "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name):
        begin = time.perf_counter()
        REGISTRY[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    run("price_by_location")
    times = {name: run(name) for name in HEADLINE}
    print(json.dumps({
        "metric": "sum of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
