"""Time the headline queries and print one JSON line.

BENCH_SF_DIR  folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    runs per query, the fastest counts (default 2)
BENCH_QUERIES space-separated names, instead of the headline list
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from workload import QUERIES

HEADLINE = [
    "clean_event_rows",
    "ingest_summary",
    "session_features_behaviour",
    "session_features_commerce",
    "session_dates_join",
    "funnel_daily",
    "funnel_daily_commerce",
    "session_days",
    "purchases_by_hour",
    "category_daily_commerce",
    "brand_daily_commerce",
    "brands_from_cube",
    "conversion_by_weekday",
    "kpi_record",
    "session_histogram",
    "approx_histogram",
    "score_sessions",
    "threshold_curve",
    "calibration_bins",
    "confusion_metrics",
    "auc_exact",
    "roc_curve",
    "time_split",
    "correlation_drivers",
    "report_totals",
    "top_brands",
    "partition_pruned_funnel",
    "csv_roundtrip",
    "report_export",
    "trained_model_metrics",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("shopflow-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="shopflow-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, sf_dir: str, name: str) -> float:
    started = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    timed(spark, sf_dir, "funnel_daily")
    seconds = {n: round(min(timed(spark, sf_dir, n) for _ in range(runs)), 3) for n in names}
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
    spark.stop()


if __name__ == "__main__":
    main()
