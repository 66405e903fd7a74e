"""Times of the headline queries: one JSON line. BENCH_SF_DIR and BENCH_CPUS set the tables and the threads."""

from __future__ import annotations

import json
import os
import time

from lodestar.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINES = (
    "search_bm25 multi_query_topk search_hybrid doc_frequency knn_exact similarity_pairs intake_class importance_score text_groups "
    "components graph_statistics bfs_hops threat_score event_tumbling event_sessions latest_before pricing_summary region_revenue "
    "order_cube top_orders cooccurrence"
).split()


def main() -> None:
    from lodestar.plans.catalogue import QUERIES

    spark = build_session("bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g"})
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(QUERIES["pricing_summary"](spark, SF_DIR))  # warms the session
    times = {}
    for name in HEADLINES:
        began = time.perf_counter()
        sink(QUERIES[name](spark, SF_DIR))
        times[name] = round(time.perf_counter() - began, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total time of the headline queries", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(SF_DIR.rstrip("/"))}))


if __name__ == "__main__":
    main()
