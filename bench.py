"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ("search_bm25_topk", "search_vector_topk", "search_hybrid", "rerank_native", "chunk_pack", "structured_facts", "tree_parents", "manifest_star", "facts_upsert", "aggregate_sources", "grep_rank", "quality_gates", "tumbling_counts", "search_bm25_weighted_fields", "coverage_check", "metric_facts")


def main() -> None:
    from papyrite import catalog_of_queries
    from papyrite.session import get_session

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", master=f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalog_of_queries.queries(), {}
    queries["facts_filter_agent"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
