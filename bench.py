"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "blob_dedup", "line_explode", "grep_literal", "grep_short", "grep_regex", "grep_ci", "grep_stats", "occurrence_locate", "term_stats", "bm25_topk", "dense_topk", "hybrid_rank",
    "cosine_all_pairs", "span_merge", "retrieval_metrics", "edges_dedup", "impact_closure", "neighbour_lanes", "route_match", "manifest_resolve", "delta_classify",
)


def main() -> None:
    from corpusloom.plans import registry
    from corpusloom.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cpus, max(4, cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = registry.queries(), {}
    for name in HEADLINE:
        best = None
        for _ in range(2):  # the first run compiles
            t = time.time()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best or 1e9, time.time() - t)
            if best > 10:
                break
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "cpus": cpus}))
    spark.stop()


if __name__ == "__main__":
    main()
