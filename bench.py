"""Time the headline queries in a warm session and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from forumlens.plans import registry  # noqa: E402
from forumlens.session import local_session  # noqa: E402

HEADLINE = (
    "store_with_dates",
    "pending_posts",
    "knn_l2_topk",
    "knn_cosine_topk",
    "lexical_match_and",
    "lexical_match_phrase",
    "lexical_match_prefix",
    "lexical_topk",
    "lexical_search",
    "token_counts",
    "truncate_text",
    "embed_posts",
    "vector_search",
    "cosine_search",
    "combined_search",
    "check_report",
    "backfill_batch",
    "repair_store",
    "rebuild_store",
    "vector_export",
    "store_upsert",
)


def timed_pass(spark, directory: str, names) -> dict[str, float]:
    all_queries = registry.all_queries()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        all_queries[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    return seconds


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    spark = local_session(cores, partitions=max(cores, 1))
    wanted = sys.argv[1:] or HEADLINE
    # The first pass pays for class loading, compilation and Python workers; both are reported.
    first = timed_pass(spark, directory, wanted)
    seconds = timed_pass(spark, directory, wanted)
    result = {
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "first_pass": first,
        "first_pass_value": round(sum(first.values()), 3),
        "sf": os.path.basename(directory.rstrip("/")).removeprefix("sf"),
        "cores": cores,
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
