"""Distinct vehicles by mergeable sketches, as an opt-in beside the exact counts.

``window_metrics`` counts vehicles exactly, which can't be added up: a vehicle seen in two windows counts in both. A sketch
per window can be merged over hours and cameras without the detections. Its relative standard error is
``standard_error(lg_k)``; small counts are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.config import STOPPED_SPEED_KMH, WINDOW_SECONDS, Scoring
from roadpulse.functions.rules import round_stable
from roadpulse.operators.windows import METRIC_COLUMNS, class_counts, class_map, classify, grains

LG_K = 12
SUMS = ("speed_sum", "speed_n", "stopped_n")


def standard_error(lg_k: int = LG_K) -> float:
    return 1.04 / (1 << lg_k) ** 0.5


def window_sketches(events: DataFrame, seconds: int = WINDOW_SECONDS, lg_k: int = LG_K) -> DataFrame:
    """A row per (camera, window) and per (camera, lane, window) with sketches of all and of stopped vehicles.

    One aggregation, whose sketches combine on the map side, so that a busy camera sends one small row per task.
    Rows without a vehicle id are in no sketch.
    """
    stopped = F.col("speed_kmh") < STOPPED_SPEED_KMH
    rows = events.select(
        F.window("ts", f"{seconds} seconds").alias("window"), "camera_id", "vehicle_id", "vehicle_class", "speed_kmh",
        F.explode(grains(F.col("lane_id"))).alias("lane_id"),
    )
    return rows.groupBy("window", "camera_id", "lane_id").agg(
        F.hll_sketch_agg("vehicle_id", F.lit(lg_k)).alias("vehicles"),
        F.hll_sketch_agg(F.when(stopped, F.col("vehicle_id")), F.lit(lg_k)).alias("stopped_vehicles"),
        *class_counts(),
        F.sum("speed_kmh").alias("speed_sum"),
        F.count("speed_kmh").alias("speed_n"),
        F.count_if(stopped).alias("stopped_n"),
    ).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "*").drop("window")


def merge_sketches(sketches: DataFrame, seconds: int, keys: tuple[str, ...] = ("camera_id", "lane_id")) -> DataFrame:
    """Sketches of longer windows, over all values of what ``keys`` leaves out; reads sketches only.

    Lanes and the camera-wide rows count the same detections: leave out ``lane_id`` only for rows of one of the two.
    """
    counts = [c for c in sketches.columns if c.startswith("_n_")]
    window = F.window("window_start", f"{seconds} seconds").alias("window")
    merged = sketches.groupBy(window, *keys).agg(
        *[F.hll_union_agg(c).alias(c) for c in ("vehicles", "stopped_vehicles")],
        *[F.sum(c).alias(c) for c in (*counts, *SUMS)],
    )
    missing = [F.lit(None).cast(t).alias(c) for c, t in (("camera_id", "string"), ("lane_id", "int")) if c not in keys]
    bounds = [F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end")]
    return merged.select(*bounds, "*", *missing).drop("window").select(*sketches.columns)


def sketched_metrics(sketches: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Metric rows of any sketches, with estimated vehicle counts and queue lengths; all else is exact."""
    measured = sketches.withColumns(
        {
            "vehicle_count": F.hll_sketch_estimate("vehicles"),
            "queue_length": F.hll_sketch_estimate("stopped_vehicles"),
            "counts_by_class": class_map(),
            "avg_speed_kmh": F.coalesce(round_stable(F.try_divide(F.col("speed_sum"), F.col("speed_n")), 2), F.lit(0.0)),
            "stopped_ratio": F.coalesce(round_stable(F.try_divide(F.col("stopped_n"), F.col("speed_n")), 4), F.lit(0.0)),
        }
    )
    return classify(measured, scoring).select(*METRIC_COLUMNS)
