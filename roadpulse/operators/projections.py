"""Projections, defaults and row predicates."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.operators.windows import METRIC_COLUMNS

Moment = datetime | str | Column


def moment(value: Moment) -> Column:
    """A point in time as a column. A time without a zone is UTC, whatever the zone of the driver."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime) and value.tzinfo is None:
        value = value.replace(tzinfo=timezone.utc)
    return F.lit(value).cast("timestamp")


def flatten_event(detections: DataFrame) -> DataFrame:
    """Typed detection to raw-event row; box edges lose their fraction, as a cast to int does."""
    return detections.select(
        "camera_id",
        F.col("timestamp").alias("ts"),
        "vehicle_id",
        F.col("class").alias("vehicle_class"),
        F.col("centroid.x").alias("centroid_x"),
        F.col("centroid.y").alias("centroid_y"),
        F.col("speed_estimate").alias("speed_kmh"),
        "frame_id",
        "confidence",
        *[F.col(f"bbox.{edge}").cast("int").alias(f"bbox_{edge}") for edge in ("x", "y", "w", "h")],
        "lane_id",
    )


def with_metric_defaults(metrics: DataFrame) -> DataFrame:
    """Numbers default to 0, class counts to an empty map, the level to LOW."""
    defaults = {
        "vehicle_count": F.lit(0),
        "counts_by_class": F.create_map().cast("map<string,bigint>"),
        "avg_speed_kmh": F.lit(0.0),
        "stopped_ratio": F.lit(0.0),
        "queue_length": F.lit(0),
        "congestion_level": F.lit("LOW"),
        "congestion_score": F.lit(0.0),
    }
    return metrics.select(
        *[F.coalesce(F.col(c), defaults[c]).alias(c) if c in defaults else F.col(c) for c in METRIC_COLUMNS]
    )


def camera_wide(metrics: DataFrame) -> DataFrame:
    """Rows that describe a whole camera."""
    return metrics.filter(F.col("lane_id").isNull())


def lane_level(metrics: DataFrame) -> DataFrame:
    """Rows that describe one lane."""
    return metrics.filter(F.col("lane_id").isNotNull())


def between(column: Column, start: Moment, end: Moment, closed: bool = True) -> Column:
    inside = column >= moment(start)
    return inside & (column <= moment(end) if closed else column < moment(end))


def in_range(
    df: DataFrame,
    start: Moment | None,
    end: Moment | None,
    as_of: Moment | None = None,
    closed: bool = True,
    column: str = "window_start",
) -> DataFrame:
    """C4: ``[start, end]``, or ``[start, end)`` when not closed.

    When a bound is missing the range is the 24 hours before ``as_of``, whatever the other bound says.
    """
    if start is None or end is None:
        if as_of is None:
            raise ValueError("as_of is required when a bound is missing")
        end = moment(as_of)
        start = end - F.expr("INTERVAL 24 HOURS")
    return df.filter(between(F.col(column), start, end, closed))


def filter_alerts(
    alerts: DataFrame,
    start: Moment | None = None,
    end: Moment | None = None,
    severity: str | None = None,
    road_segment: str | None = None,
    alert_type: str | None = None,
    camera_id: str | None = None,
) -> DataFrame:
    """Every given option narrows the result; severity and type ignore case."""
    if start is not None:
        alerts = alerts.filter(F.col("triggered_at") >= moment(start))
    if end is not None:
        alerts = alerts.filter(F.col("triggered_at") <= moment(end))
    wanted = {
        "severity": severity and severity.upper(),
        "road_segment": road_segment,
        "alert_type": alert_type and alert_type.upper(),
        "camera_id": camera_id,
    }
    for column, value in wanted.items():
        if value:
            alerts = alerts.filter(F.col(column) == value)
    return alerts


def recent_lanes(metrics: DataFrame, as_of: Moment, minutes: int) -> DataFrame:
    """Lane rows of the minutes before ``as_of``."""
    end = moment(as_of)
    start = end - F.make_dt_interval(mins=F.lit(minutes))
    return in_range(lane_level(metrics), start, end, closed=False)
