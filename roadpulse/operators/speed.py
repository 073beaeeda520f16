"""Speed from successive positions where a detection carries none."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import SpeedFallback
from roadpulse.functions.rules import seconds_between
from roadpulse.plans.slices import MICROS, SLICE, drop_copies, overlap


def speed_between(x: Column, y: Column, ts: Column, last: Column, px_to_m: Column, ttl_seconds: int) -> Column:
    """km/h from the previous sighting; NULL without one, without elapsed time, or once it is too old."""
    elapsed = seconds_between(ts, last["ts"])
    metres = F.hypot(x - last["x"], y - last["y"]) * px_to_m
    return F.when((elapsed > 0) & (elapsed <= ttl_seconds), metres / elapsed * 3.6)


def fill_speed(
    events: DataFrame,
    calibration: DataFrame | dict[str, float] | None = None,
    config: SpeedFallback = SpeedFallback(),
    slices_per_ttl: int = 20,
) -> DataFrame:
    """Fill ``speed_kmh`` where it is NULL; a given speed is kept, but its position still counts as a sighting.

    The previous sighting is per vehicle, over all cameras, in event-time order. A sighting expires after the TTL, so
    a row can only depend on rows at most one TTL older: the history of a vehicle is cut into slices of many TTLs,
    and only the last TTL of a slice (one row in ``slices_per_ttl``) is copied into the next one. One shuffle, and a
    vehicle id that owns a third of all rows still spreads over as many tasks as it has slices.
    """
    ttl = config.ttl_seconds * MICROS
    placed = overlap(events, F.unix_micros("ts"), ttl * slices_per_ttl, before=ttl)
    order = W.partitionBy("vehicle_id", SLICE).orderBy("ts", "frame_id")
    sighting = F.struct(F.col("centroid_x").alias("x"), F.col("centroid_y").alias("y"), "ts")
    sighted = drop_copies(placed.withColumn("_last", F.lag(sighting).over(order)))
    scaled, px_to_m = with_scale(sighted, calibration, config.pixel_to_meter)
    estimate = speed_between(
        F.col("centroid_x"), F.col("centroid_y"), F.col("ts"), F.col("_last"), px_to_m, config.ttl_seconds
    )
    return scaled.withColumn("speed_kmh", F.coalesce("speed_kmh", estimate)).select(*events.columns)


def with_scale(
    df: DataFrame, calibration: DataFrame | dict[str, float] | None, default: float
) -> tuple[DataFrame, Column]:
    """Metres per pixel of the row's camera. A dict is a setting and becomes a literal; a table is joined."""
    if isinstance(calibration, DataFrame):
        scale = calibration.select("camera_id", F.col("meters_per_pixel").alias("_px"))
        return df.join(scale, "camera_id", "left"), F.coalesce(F.col("_px"), F.lit(default))
    if calibration:
        pairs = F.create_map(*[F.lit(part) for item in calibration.items() for part in item])
        return df, F.coalesce(F.element_at(pairs, F.col("camera_id")), F.lit(default))
    return df, F.lit(default)
