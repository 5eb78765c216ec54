"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sparkassay import workload  # noqa: E402

HEADLINE = (
    "audit_report",
    "completeness_rate_all",
    "uniqueness_rate",
    "uniqueness_rate_text",
    "outlier_rate_iqr",
    "outlier_rates",
    "outlier_rate_zscore",
    "exact_duplicate_overlap_rate",
    "duplicate_overlap_splits",
    "variance_inflation_factors",
    "population_stability_index",
    "target_leakage_count",
    "class_imbalance_ratio",
    "demographic_parity_disparity",
    "change_point_score",
    "change_point_score_long",
    "pii_contamination_rate",
    "pii_phi_contamination_rate",
    "detect_identifiers",
    "blur_index",
    "blur_index_of_pixels",
    "iou_pairs",
    "vector_topk_cosine",
    "vector_upsert",
    "search_metrics",
    "resolve_plan",
    "foreign_key_check",
    "sample_fraction",
    "paginate_deep",
    "extract_json_text",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    only = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in only:
        query, times = workload.QUERIES[name], []
        for _ in range(runs + 1):  # the first run warms up
            start = time.perf_counter()
            query(spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 4)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "sum of median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
