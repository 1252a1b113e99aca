"""Benchmark the headline queries.

Runs each query at $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS] and forces full evaluation with a no-op write.  Prints one
JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dendra.session import build_session  # noqa: E402
from dendra.plans import queries as Q  # noqa: E402

HEADLINE = [
    "knn_top5",            # exact dense kNN (block products)
    "knn_vote",            # kNN + majority vote
    "silhouette",          # O(N^2) metric as block sums
    "davies_bouldin",
    "run_metrics",
    "tfidf_weights",       # tokenise + TF-IDF over whole texts
    "sparse_top5",         # sparse search
    "hybrid_top5",         # dense + sparse search
    "first_seen_dedup",    # ingest
    "topic_quota_before_dedup",
    "cluster_summary",     # reports
    "mst_weight",          # Borůvka MST of the mutual-reachability graph
    "hdbscan_leaf",        # full density clustering of the embeddings
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = build_session(f"local[{cpus}]", app="dendra-bench",
                          shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)))
    times = {}
    for name in only:
        fn = Q.QUERIES[name]
        t0 = time.time()
        fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr, flush=True)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times,
                      "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
