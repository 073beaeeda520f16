"""Tumbling-window metrics in two grains from one pass. The same plan runs on batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.config import STOPPED_SPEED_KMH, VEHICLE_CLASSES, WINDOW_SECONDS, Scoring
from roadpulse.functions.rules import congestion_score, level_of, round_stable

METRIC_COLUMNS = (
    "camera_id",
    "window_start",
    "window_end",
    "lane_id",
    "vehicle_count",
    "counts_by_class",
    "avg_speed_kmh",
    "stopped_ratio",
    "queue_length",
    "congestion_level",
    "congestion_score",
)


def grains(lane_id: Column) -> Column:
    """Each detection counts camera-wide (NULL lane) and, if it has a lane, for that lane too."""
    whole = F.lit(None).cast("int")
    return F.when(lane_id.isNull(), F.array(whole)).otherwise(F.array(whole, lane_id))


def window_metrics(events: DataFrame, seconds: int = WINDOW_SECONDS, scoring: Scoring = Scoring()) -> DataFrame:
    """Metrics per (camera, window) and per (camera, lane, window) from rows of the raw-event shape."""
    return window_rows(events, seconds, scoring).select(*METRIC_COLUMNS)


def window_rows(events: DataFrame, seconds: int = WINDOW_SECONDS, scoring: Scoring = Scoring()) -> DataFrame:
    """``window_metrics`` with the ``window`` column, which further aggregations on a stream need.

    The first aggregation reduces each vehicle within a window to one row, spreading a busy camera over all tasks by
    vehicle; the second adds vehicles up. Distinct counts thereby become plain counts, no set of vehicles is ever
    held in memory, and both aggregations combine on the map side.
    """
    return add_vehicles(vehicle_rows(events, seconds), scoring)


def vehicle_rows(events: DataFrame, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """What each vehicle adds to a (window, camera, lane) of either grain: sums, which may be added up further."""
    return (
        events.select(
            F.window("ts", f"{seconds} seconds").alias("window"),
            "camera_id",
            "vehicle_id",
            "vehicle_class",
            "speed_kmh",
            F.explode(grains(F.col("lane_id"))).alias("lane_id"),
        )
        .groupBy("window", "camera_id", "lane_id", "vehicle_id")
        .agg(
            *class_counts(),
            F.sum("speed_kmh").alias("_speed_sum"),
            F.count("speed_kmh").alias("_speed_n"),
            F.count_if(F.col("speed_kmh") < STOPPED_SPEED_KMH).alias("_stopped_n"),
        )
    )


def add_vehicles(per_vehicle: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Metrics, with ``window``, from one row per (window, camera, lane, vehicle)."""
    per_window = per_vehicle.groupBy("window", "camera_id", "lane_id").agg(
        F.count(F.lit(1)).alias("vehicle_count"),
        *[F.sum(f"_n_{name}").alias(f"_n_{name}") for name in VEHICLE_CLASSES],
        F.sum("_speed_sum").alias("_speed_sum"),
        F.sum("_speed_n").alias("_speed_n"),
        F.sum("_stopped_n").alias("_stopped_n"),
        F.count_if(F.col("_stopped_n") > 0).alias("queue_length"),
    )
    mean_speed = F.try_divide(F.col("_speed_sum"), F.col("_speed_n"))
    stopped = F.try_divide(F.col("_stopped_n"), F.col("_speed_n"))
    measured = per_window.select(
        "window",
        "camera_id",
        F.col("window.start").alias("window_start"),
        F.col("window.end").alias("window_end"),
        "lane_id",
        "vehicle_count",
        class_map().alias("counts_by_class"),
        F.coalesce(round_stable(mean_speed, 2), F.lit(0.0)).alias("avg_speed_kmh"),
        F.coalesce(round_stable(stopped, 4), F.lit(0.0)).alias("stopped_ratio"),
        "queue_length",
    )
    return classify(measured, scoring)


def class_counts() -> list[Column]:
    """Aggregates: detections of each class."""
    return [F.count_if(F.col("vehicle_class") == name).alias(f"_n_{name}") for name in VEHICLE_CLASSES]


def class_map() -> Column:
    """The classes with detections, from the columns of ``class_counts``."""
    names = F.array(*[F.lit(name) for name in VEHICLE_CLASSES])
    counts = F.array(*[F.col(f"_n_{name}") for name in VEHICLE_CLASSES])
    return F.map_filter(F.map_from_arrays(names, counts), lambda _, n: n > 0)


def classify(df: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Add level and score. The level comes from the unrounded score."""
    score = congestion_score(F.col("vehicle_count"), F.col("avg_speed_kmh"), F.col("stopped_ratio"), scoring)
    return (
        df.withColumn("_score", score)
        .withColumn("congestion_level", level_of(F.col("_score"), scoring.thresholds))
        .withColumn("congestion_score", round_stable(F.col("_score"), 4))
        .drop("_score")
    )
