"""Time the headline queries and print one JSON line.

Each query runs once on the smallest tables to warm the JVM and then once, timed, on
``$BENCH_SF_DIR``; every row of the result is computed.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from seenscope.catalog.queries import QUERIES  # noqa: E402
from seenscope.session import build_session  # noqa: E402

HEADLINE = [
    "sample_exact",
    "sample_stratified",
    "split_stratified_half",
    "multi_task_union",
    "tokens",
    "ngram_model",
    "token_logprobs",
    "score_table",
    "metrics_summary",
    "roc_points",
    "trajectory",
    "trace_features",
    "trace_eval",
]
WARM_UP_DIR = "/root/testdata/sf0.001"


def run(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "bench",
        shuffle_partitions=None if cpus == "*" else int(cpus),
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        if os.path.isdir(WARM_UP_DIR):
            run(spark, name, WARM_UP_DIR)
        times[name] = round(run(spark, name, sf_dir), 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
