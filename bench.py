"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the input and cores.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from furrow.catalog import load_all
from furrow.session import local_session

HEADLINE = [
    "rolling_median_30",
    "rolling_medians_all_levels",
    "lag_features",
    "seasonal_median",
    "cap_group_cascade",
    "hierarchical_median_baseline",
    "regression_metrics",
    "conformal_bands",
    "profile_numeric",
    "year_drift",
    "row_drift",
    "weekly_report",
    "wasserstein",
    "train_gbt",
    "stream_row_drift",
    "flagship",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("OFF")
    queries = load_all()[0]

    def once(name: str) -> float:
        start = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.time() - start

    once("regression_metrics")  # warm-up: class loading and Python workers
    times = {}
    for name in HEADLINE:
        first = once(name)
        # Short queries are repeated and their median taken.
        runs = [first] if first > 8 else [first, once(name), once(name)]
        times[name] = round(statistics.median(runs), 3)
    line = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf.rstrip("/")).replace("sf", "")}
    line["sf"] = float(line["sf"]) if line["sf"].replace(".", "", 1).isdigit() else line["sf"]
    print(json.dumps(line))


if __name__ == "__main__":
    main()
