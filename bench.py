"""Headline queries, one timing each; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pagelake.plans.catalog import all_queries
from pagelake.session import local_session

HEADLINE = (
    "reindex_all",
    "index_build",
    "element_index_build",
    "text_recall",
    "vector_recall",
    "hybrid_search",
    "duplicate_groups",
    "similar_slides",
    "suggest_versions",
    "match_versions",
    "eval_recall_ndcg",
    "parse_packages",
    "merge_ai_tags",
    "job_targets",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session("pagelake-bench", cpus, shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    catalog = all_queries()
    seconds = {}
    for name in wanted:
        start = time.perf_counter()
        catalog[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    line = {"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}
    print(json.dumps(line))
    spark.stop()


if __name__ == "__main__":
    main()
