"""Times headline queries on one warm session and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Each
query is planned and run to its last row (a write that keeps nothing); the best of two runs counts.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

HEADLINE = (
    "kg_fact", "kg_temporal_after", "kg_causal_depth2", "kg_multi_hop", "kg_execute_batch", "resolve_fact_rank",
    "knn_topk", "knn_boosted", "rerank_score", "evidence_window", "sentence_support", "query_plan_batch", "seed_entities",
    "sentence_split", "key_terms", "event_detect", "event_arguments", "chunk_fold", "chunk_stats_rollup", "edge_merge", "entity_registry",
)
#: Queries that answer a question of each customer.
ASKED = ("kg_fact", "kg_temporal_after", "kg_causal_depth2", "kg_multi_hop")


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from quillgraph import registry

    queries = registry.queries()
    spark.read.parquet(f"{folder}/documents.parquet").count()
    took = {}
    for name in HEADLINE:
        best = None
        for _ in range(2):
            began = time.perf_counter()
            queries[name](spark, folder).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - began
            best = spent if best is None else min(best, spent)
        took[name] = round(best, 3)
    customers = spark.read.parquet(f"{folder}/customer.parquet").count()
    spark.stop()
    each = {name: round(1000 * took[name] / customers, 3) for name in ASKED}
    print(json.dumps({"metric": "headline queries, seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": folder.rstrip("/").rpartition("sf")[2], "questions": customers, "ms_a_question": each}))


if __name__ == "__main__":
    main()
