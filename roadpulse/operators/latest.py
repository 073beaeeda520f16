"""Current state and plain look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.projections import Moment, camera_wide, in_range, lane_level, with_metric_defaults
from roadpulse.operators.windows import METRIC_COLUMNS


def _latest(metrics: DataFrame, *keys: str) -> DataFrame:
    """Newest row per key: each task keeps one row per key before anything is shuffled.

    The keys come out as grouping columns, so that filters on them reach the scan.
    """
    newest = F.max_by(F.struct(*[c for c in METRIC_COLUMNS if c not in keys]), "window_start").alias("row")
    return metrics.groupBy(*keys).agg(newest).select(*keys, "row.*").select(*METRIC_COLUMNS)


def latest_per_camera(metrics: DataFrame, camera_id: str | None = None) -> DataFrame:
    """D1."""
    rows = camera_wide(metrics)
    if camera_id is not None:
        rows = rows.filter(F.col("camera_id") == camera_id)
    return _latest(rows, "camera_id")


def latest_per_lane(metrics: DataFrame, camera_id: str | None = None) -> DataFrame:
    """D2."""
    rows = lane_level(metrics)
    if camera_id is not None:
        rows = rows.filter(F.col("camera_id") == camera_id)
    return _latest(rows, "camera_id", "lane_id")


def current_metrics(metrics: DataFrame, camera_id: str) -> DataFrame:
    """D3: the newest row of one camera, or a zero row without times when it has none.

    An aggregate without grouping returns exactly one row, so no join against a made-up row is needed.
    """
    rows = camera_wide(metrics).filter(F.col("camera_id") == camera_id)
    newest = rows.agg(F.max_by(F.struct(*METRIC_COLUMNS), "window_start").alias("row")).select("row.*")
    return with_metric_defaults(newest.withColumn("camera_id", F.lit(camera_id)))


def list_cameras(metrics: DataFrame) -> DataFrame:
    """Cameras seen, with the end of their newest window."""
    return metrics.groupBy("camera_id").agg(F.max("window_end").alias("last_seen"))


def recent_events(events: DataFrame, n: int = 10) -> DataFrame:
    """G1: the newest ``n`` raw events."""
    if not 1 <= n <= 100:
        raise ValueError("n must be between 1 and 100")
    newest = events.orderBy(F.desc("ts"), F.desc("frame_id")).limit(n)
    return newest.select(
        "camera_id", F.col("ts").alias("timestamp"), "vehicle_id", F.col("vehicle_class").alias("class"),
        "lane_id", "speed_kmh", "confidence",
    )


def metrics_history(metrics: DataFrame, camera_id: str, start: Moment, end: Moment) -> DataFrame:
    """Camera-wide rows of one camera, oldest first."""
    rows = in_range(camera_wide(metrics).filter(F.col("camera_id") == camera_id), start, end)
    return with_metric_defaults(rows).orderBy("window_start")


def scan_lane_metrics(metrics: DataFrame, start: Moment, end: Moment) -> DataFrame:
    """A3: per-lane rows in ``[start, end)`` with the columns that forecasting needs."""
    rows = in_range(lane_level(metrics), start, end, closed=False)
    return rows.select(
        "camera_id", "lane_id", "window_start", "vehicle_count", "avg_speed_kmh", "stopped_ratio",
        "congestion_score", "congestion_level",
    ).orderBy("camera_id", "lane_id", "window_start")
