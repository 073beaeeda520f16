"""The figures of a dashboard and its map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import INCIDENT_LEVELS, LEVELS
from roadpulse.functions.rules import clamp, level_rank, round_stable
from roadpulse.operators.latest import latest_per_camera
from roadpulse.operators.projections import Moment, camera_wide, moment


def _minutes_before(as_of: Moment, minutes: int) -> Column:
    return moment(as_of) - F.make_dt_interval(mins=F.lit(minutes))


def with_coords(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Rows of cameras whose place is known."""
    located = registry.filter(F.col("latitude").isNotNull() & F.col("longitude").isNotNull())
    return df.join(located.select("camera_id", "latitude", "longitude", "road_segment"), "camera_id")


def dashboard_summary(
    metrics: DataFrame, alerts: DataFrame, as_of: Moment, minutes: int = 5, alert_hours: int = 24
) -> DataFrame:
    """One row of key figures.

    Metrics shrink to one partial row per camera and alerts to flags; both kinds of rows meet in one global
    aggregate, so three one-row results need not be joined.
    """
    recent = F.col("window_start") >= _minutes_before(as_of, minutes)
    latest = F.struct("congestion_level", "congestion_score", "vehicle_count")
    cameras = camera_wide(metrics).groupBy("camera_id").agg(
        F.max_by(latest, "window_start").alias("latest"),
        F.sum(F.when(recent, F.col("avg_speed_kmh"))).alias("speed_sum"),
        F.count(F.when(recent, F.col("avg_speed_kmh"))).alias("speed_n"),
        F.sum(F.when(recent, F.col("congestion_score"))).alias("score_sum"),
        F.count(F.when(recent, F.col("congestion_score"))).alias("score_n"),
    )
    flags = alerts.select(
        F.col("resolved_at").isNull().alias("unresolved"),
        (F.col("triggered_at") >= _minutes_before(as_of, alert_hours * 60)).alias("of_last_day"),
    )
    rows = cameras.unionByName(flags, allowMissingColumns=True)

    level = F.coalesce("latest.congestion_level", F.lit("LOW"))
    is_camera = F.col("camera_id").isNotNull()
    worst_first = F.struct(level_rank(level), F.coalesce("latest.congestion_score", F.lit(0.0)), "camera_id")
    worst = F.struct("camera_id", "latest.congestion_level", "latest.congestion_score")
    breakdown = [part for name in LEVELS for part in (F.lit(name), F.count_if(is_camera & (level == name)))]
    mean_speed = F.coalesce(round_stable(F.try_divide(F.sum("speed_sum"), F.sum("speed_n")), 2), F.lit(0.0))
    mean_score = F.coalesce(round_stable(F.try_divide(F.sum("score_sum"), F.sum("score_n")), 4), F.lit(0.0))
    return rows.agg(
        F.count_if("unresolved").alias("active_alerts"),
        F.count_if("of_last_day").alias("total_incidents_24h"),
        mean_speed.alias("average_speed_kmh_5m"),
        mean_score.alias("average_congestion_score_5m"),
        F.count("camera_id").alias("total_cameras_active"),
        F.coalesce(F.sum("latest.vehicle_count"), F.lit(0)).alias("total_vehicles_last_window"),
        mean_speed.alias("average_speed_kmh"),
        F.create_map(*breakdown).alias("congestion_breakdown"),
        F.max_by(worst, F.when(is_camera, worst_first)).alias("worst_camera"),
    )


def level_breakdown(metrics: DataFrame) -> DataFrame:
    """Cameras per level in their latest window; every level appears."""
    level = F.coalesce("congestion_level", F.lit("LOW"))
    return latest_per_camera(metrics).agg(*[F.count_if(level == name).alias(name.lower()) for name in LEVELS])


def worst_camera(metrics: DataFrame) -> DataFrame:
    """The camera with the highest level; score and then id decide between equals. No row without cameras."""
    rank = F.struct(level_rank(F.col("congestion_level")), F.coalesce("congestion_score", F.lit(0.0)), "camera_id")
    row = F.struct("camera_id", "congestion_level", "congestion_score")
    worst = latest_per_camera(metrics).agg(F.max_by(row, rank).alias("worst"))
    return worst.filter(F.col("worst").isNotNull()).select("worst.*")


def incidents(metrics: DataFrame, registry: DataFrame, severity: str | None = None) -> DataFrame:
    """Cameras on the map whose latest window is HIGH or SEVERE, or exactly ``severity`` if given."""
    if severity is not None and severity not in LEVELS:
        raise ValueError(f"severity must be one of {LEVELS}")
    level = F.coalesce("congestion_level", F.lit("LOW"))
    wanted = [severity] if severity is not None else list(INCIDENT_LEVELS)
    latest = latest_per_camera(metrics).withColumn("severity", level).filter(F.col("severity").isin(*wanted))
    return with_coords(latest, registry).select(
        "camera_id",
        "latitude",
        "longitude",
        "road_segment",
        "severity",
        F.col("congestion_score").alias("score"),
        F.coalesce("vehicle_count", F.lit(0)).alias("vehicle_count"),
        F.coalesce("queue_length", F.lit(0)).alias("queue_length"),
        F.coalesce("avg_speed_kmh", F.lit(0.0)).alias("avg_speed_kmh"),
        F.coalesce("counts_by_class", F.create_map().cast("map<string,bigint>")).alias("counts_by_class"),
        "window_end",
    )


def heat_snapshot(metrics: DataFrame, as_of: Moment, minutes: int = 5) -> DataFrame:
    """Mean score and mean vehicle count per camera over the last minutes."""
    return _heat(metrics, as_of, minutes).select(
        "camera_id",
        F.coalesce(round_stable(F.col("score"), 4), F.lit(0.0)).alias("intensity"),
        F.coalesce(round_stable(F.col("avg_count"), 2), F.lit(0.0)).alias("avg_vehicle_count"),
    )


def _heat(metrics: DataFrame, as_of: Moment, minutes: int) -> DataFrame:
    recent = camera_wide(metrics).filter(F.col("window_start") >= _minutes_before(as_of, minutes))
    return recent.groupBy("camera_id").agg(
        F.avg("congestion_score").alias("score"),
        F.avg("vehicle_count").alias("avg_count"),
        F.max("window_end").alias("last_window"),
    )


def heatmap(metrics: DataFrame, registry: DataFrame, as_of: Moment, minutes: int = 5) -> DataFrame:
    """Located cameras with their share of the busiest one's mean vehicle count."""
    points = with_coords(_heat(metrics, as_of, minutes), registry)
    # One row per camera of the registry: the only window over all of them, and no second pass over the metrics.
    points = points.withColumn("busiest", F.max(F.coalesce("avg_count", F.lit(0.0))).over(W.partitionBy()))
    share = F.coalesce("avg_count", F.lit(0.0)) / F.col("busiest")
    return points.select(
        "camera_id",
        "latitude",
        "longitude",
        "road_segment",
        F.when(F.col("busiest") > 0, round_stable(clamp(share), 4)).otherwise(0.0).alias("weight"),
        F.coalesce(round_stable(F.col("score"), 4), F.lit(0.0)).alias("intensity"),
        F.coalesce(round_stable(F.col("avg_count"), 2), F.lit(0.0)).alias("avg_vehicle_count"),
        "last_window",
    )
