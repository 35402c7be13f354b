"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON."""

from __future__ import annotations

import json
import os
import sys
import time

from lodeline.session import local_session

#: The best of RUNS counts: the first compiles code.
RUNS = 2
NAMES = (
    "knn_cosine", "knn_batch", "knn_filter_post", "metric_compare", "sq8_knn", "bm25_topk", "hybrid_search", "doc_vector_search",
    "chunk_fixed", "sentences_chunker", "semantic_chunks", "rerank_topk", "grounding_report", "pca_3d", "cluster_analytics", "hnsw_graph_search",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, shuffle_partitions=cores, app="bench")
    from lodeline.plans.registry import QUERIES

    took = {}
    for name in NAMES:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        took[name] = round(min(times), 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({"metric": "headline queries, best of two runs", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
