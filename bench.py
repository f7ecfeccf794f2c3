"""Times the headline queries (the better of two warm runs each) and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from fleetlens.session import local_session
from fleetlens.testbed.queries import REGISTRY

HEADLINE = (
    "sensor_timeline",
    "sensor_cohort",
    "cosensor_timeline",
    "patch_presence",
    "software_change_presence",
    "app_fault_presence",
    "presence_all_sensors",
    "presence_top15",
    "drilldown_model",
    "drilldown_ranged",
    "whole_report",
    "location_counts",
    "title_top20",
    "health_summary",
    "compare_machines",
    "enriched_series",
    "decompose",
    "trend_anomalies",
    "snapshot_change",
    "anomaly_report_patches",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = local_session(cores, "fleetlens-bench")
    for name in HEADLINE:  # first runs pay for class loading and code generation
        run(spark, sf_dir, name)
    seconds = {name: round(min(run(spark, sf_dir, name) for _ in range(2)), 3) for name in HEADLINE}
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
