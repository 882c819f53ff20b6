"""Time the headline queries: the median of three runs after one warm-up; prints one JSON line.

BENCH_SF_DIR, BENCH_CPUS and BENCH_RUNS change the tables, the cores and the number of runs.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join([HERE, *filter(None, [os.environ.get("PYTHONPATH")])])  # for the workers

HEADLINE = ["vector_topk", "vector_batch_topk", "hybrid_weighted", "hybrid_topic_boost", "hybrid_multi_source", "rrf_weighted", "rrf_multi_query", "keyword_search_tf", "keyword_search_bm25", "doc_router", "cache_lookup", "sibling_window", "hierarchy_expand_budget", "topic_tag_rules", "greedy_chunks", "page_index", "transcript_chunks_60s", "daily_cost", "cost_by_type_total", "job_queue_stats", "dedup_by_hash", "status_upsert", "query_classify", "convo_context"]


def main() -> None:
    from ravine.plans.registry import QUERIES
    from ravine.session import session

    sf, runs = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_RUNS", "3"))
    spark = session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        each = []
        for _ in range(runs + 1):  # the first is a warm-up
            began = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        print(name, [round(x, 2) for x in each], file=sys.stderr, flush=True)
        seconds[name] = round(statistics.median(each[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf.rstrip("/")), "cores": spark.sparkContext.defaultParallelism, "runs": runs}))
    spark.stop()


if __name__ == "__main__":
    main()
