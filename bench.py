"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [--all]

Every query runs three times and the median counts, so that one cold run does no harm.
Results are computed in full and thrown away.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from catalog import QUERIES
from hazardframe.session import local_session

HEADLINE = [
    "kpis",
    "by_severity",
    "by_hour",
    "top_regions",
    "top_roads",
    "causes_by_severity",
    "cause_severity_pivot",
    "speed_profile",
    "cost_by_region",
    "running_deaths",
    "top_night_zones",
    "excess_speed_by_severity",
    "dedup_first",
    "describe",
    "anomaly_report",
    "target_rates",
    "speed_box_by_severity",
    "hour_weekday_matrix",
    "association_ranking",
    "correlation_matrix",
    "black_spots",
    "class_auc",
    "clean_incidents",
    "features_of_clean",
]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = list(QUERIES) if "--all" in sys.argv else HEADLINE
    spark = local_session(cores, "bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        times = []
        for _ in range(RUNS):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{name:30} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
