"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the folder of tables, BENCH_CPUS the local cores. Each query runs RUNS
times; the median counts, which leaves out a cold first run. Every result is computed in
full and discarded, and what the query staged is removed.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.operators.stage import staging  # noqa: E402
from faultline.plans import registry  # noqa: E402
from faultline.session import local_session  # noqa: E402

HEADLINE = (
    "regression_summary", "failed_tests", "log_paths", "classified_lines", "analyze_failure",
    "all_errors", "log_tail", "failed_tests_with_errors", "keywords", "match_issues",
    "solution_sentence_match", "search_text", "find_solutions", "batch_summary",
)
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "faultline-bench")
    queries = registry.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        with staging(spark):
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
        return took

    times = {}
    for name in HEADLINE:
        times[name] = round(statistics.median(run(name) for _ in range(RUNS)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3),
        "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
