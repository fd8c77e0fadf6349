"""Benchmark: run the headline registered queries on the driver's tables and
print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) pick
the data and local parallelism. Each query runs to completion through the
``noop`` sink (the whole plan executes, nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans import catalog  # noqa: E402
from faultline.session import get_session  # noqa: E402

HEADLINE = [
    "outlier_topk", "outlier_topk_per_repo", "fan_in", "fan_in_no_self", "touch_no_history",
    "baseline_delta", "drift_candidates", "gate_verdict", "scan_report", "validation_full",
    "drift_summary", "split_duplicates", "symbol_membership", "decision_points", "line_count",
    "prompt_build", "link_fan_in", "path_keys", "json_required", "import_resolution",
    "source_metrics", "source_scan", "drift_prompts", "gate_changes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = get_session(f"local[{cpus}]", app="faultline-bench",
                        shuffle_partitions=max(8, cpus * 2),
                        extra={"spark.driver.memory": "16g"})
    # Session start-up (JVM class loading, first job) is not query time.
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = sf_dir.rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir}))


if __name__ == "__main__":
    main()
