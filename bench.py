"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local threads, ``BENCH_QUERIES`` a comma list of
queries instead of the headline ones. Each query runs in full into a sink that drops its rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "validate_events",
    "speed_fallback",
    "window_metrics_camera",
    "window_metrics_lane",
    "volume_window_metrics",
    "window_metrics_filled",
    "latest_per_camera",
    "range_summary",
    "hourly_trends",
    "top_segments",
    "compare_ranges",
    "dashboard_summary",
    "heatmap",
    "incidents",
    "alerts_from_metrics",
    "acknowledge_alerts",
    "upsert_metrics",
    "camera_changes",
    "gap_fill",
    "dense_signal",
    "sliding_samples",
    "ewma_forecast",
    "congestion_episodes",
    "khop_neighbours",
    "sensor_import",
    "forecast_metrics",
    "training_table",
    "ml_forecast",
    "stream_window_metrics",
    "stream_alerts",
    "forecast_messages",
    "ml_evaluation",
    "stream_speed",
    "stream_rollup",
    "stream_events",
    "stream_detections_to_alerts",
)


def main() -> None:
    from roadpulse.catalog import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/events.parquet").groupBy("event_type").count().collect()  # start the executor

    seconds = {}
    for name in names:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        print(f"{name:24s} {seconds[name]:8.3f}", file=sys.stderr, flush=True)
    rows = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet").count() for n in ("events", "lineitem")}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "rows": rows,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
