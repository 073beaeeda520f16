"""Loop-detector readings as lane metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.config import SENSOR_SCORING, Scoring
from roadpulse.functions.rules import clamp, congestion_score, level_of, plus_seconds, round_stable
from roadpulse.operators.windows import METRIC_COLUMNS
from roadpulse.schemas import SENSOR_EDGE

# Fixed value: queue length that a fully occupied detector stands for.
QUEUE_AT_FULL_OCCUPANCY = 30


def import_sensor_series(
    readings: DataFrame, mapping: DataFrame, step_seconds: int = 300, scoring: Scoring = SENSOR_SCORING
) -> DataFrame:
    """A4, C14: readings ``(t, sensor_id, flow, occupancy, speed)`` of mapped sensors as per-lane metric rows.

    Unlike live windows the level comes from the rounded score.
    """
    mapped = readings.join(mapping.select("sensor_id", "camera_id", "lane_id"), "sensor_id")
    measured = mapped.select(
        "camera_id",
        F.col("t").alias("window_start"),
        plus_seconds(F.col("t"), step_seconds).alias("window_end"),
        "lane_id",
        F.bround(F.greatest("flow", F.lit(0.0)), 0).cast("long").alias("vehicle_count"),
        F.round(F.greatest("speed", F.lit(0.0)), 2).alias("avg_speed_kmh"),
        F.round(clamp(F.col("occupancy")), 4).alias("stopped_ratio"),
    )
    count, stopped = F.col("vehicle_count"), F.col("stopped_ratio")
    scored = measured.withColumns(
        {
            "counts_by_class": F.create_map(F.lit("car"), count),
            "queue_length": (stopped * QUEUE_AT_FULL_OCCUPANCY).cast("long"),
            "congestion_score": round_stable(
                congestion_score(count, F.col("avg_speed_kmh"), stopped, scoring), 4
            ),
        }
    )
    level = level_of(F.col("congestion_score"), scoring.thresholds)
    return scored.withColumn("congestion_level", level).select(*METRIC_COLUMNS)


def read_adjacency(spark: SparkSession, path: str) -> DataFrame:
    """A5: sensor adjacency ``from,to,cost`` with a header line."""
    return spark.read.csv(path, header=True, schema=SENSOR_EDGE)


def map_adjacency(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adjacencies between mapped sensors as lane links, marked as within or across cameras."""
    for end in ("from", "to"):
        side = mapping.select(
            F.col("sensor_id").alias(end), F.col("camera_id").alias(f"{end}_camera"), F.col("lane_id").alias(f"{end}_lane")
        )
        edges = edges.join(side, end)
    kind = F.when(F.col("from_camera") == F.col("to_camera"), "intra").otherwise("cross")
    return edges.select("from_camera", "from_lane", "to_camera", "to_lane", kind.alias("kind"))
