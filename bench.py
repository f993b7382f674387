"""Benchmark the headline queries.

Runs each query in BENCH_QUERIES on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS], $BENCH_REPEATS times (default 3), and prints one JSON
line with the median seconds per query and their sum.  Execution is forced
with the ``noop`` sink, so every row is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from retailcast.plans.queries import QUERIES  # noqa: E402
from retailcast.session import get_session  # noqa: E402

BENCH_QUERIES = ["q_feature_table", "q_lags", "q_promo_totals", "q_oil_smooth",
                 "q_knn_regress", "q_hybrid_boosted"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else \
        BENCH_QUERIES
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    times: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(repeats):
            t0 = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
            spark.catalog.clearCache()
        times[name] = round(statistics.median(runs), 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
