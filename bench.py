"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from wattline.queries import QUERIES
from wattline.session import build_session

HEADLINE = [
    "meter_features", "one_hot_data", "label_encode", "clean_values", "time_cutoff", "time_cutoff_groups",
    "stride_windows", "split_windows", "test_windows", "weekly_windows", "window_long_stats", "instance_norm",
    "assign_nodes", "assign_rows", "split_exact", "assign_balanced", "balanced_sample", "bce_loss", "class_report",
    "threshold_sweep", "avg_precision", "roc_auc", "standardize", "standardize_nodes", "split_summary",
    "client_metrics_all", "early_stop", "median_prune", "client_files", "local_fit", "federated_rounds",
    "evaluate_rounds", "evaluate_final", "mlp_fit", "search_trials",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "6g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    run(QUERIES["meter_features"](spark, folder))  # start the JVM's compilers and the executors once
    times = {}
    for name in names:
        start = time.perf_counter()
        run(QUERIES[name](spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline query time", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
