"""Event-time windows on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.config import LATENESS_SECONDS, WINDOW_SECONDS, Scoring
from roadpulse.operators.windows import window_metrics, window_rows


def stream_metrics(
    events: DataFrame,
    seconds: int = WINDOW_SECONDS,
    lateness_seconds: int = LATENESS_SECONDS,
    scoring: Scoring = Scoring(),
) -> DataFrame:
    """The batch plan behind a watermark. A window comes out once, when the watermark has passed its end.

    The watermark is global: rows of a camera that lags behind the others by more than the lateness are dropped and
    counted by the query's progress.
    """
    return window_metrics(events.withWatermark("ts", f"{lateness_seconds} seconds"), seconds, scoring)


def stream_rollup(
    events: DataFrame,
    seconds: int = WINDOW_SECONDS,
    rollup_seconds: int = 3600,
    lateness_seconds: int = LATENESS_SECONDS,
    scoring: Scoring = Scoring(),
) -> DataFrame:
    """Camera figures per hour, aggregated from the windows of the same stream."""
    rows = window_rows(events.withWatermark("ts", f"{lateness_seconds} seconds"), seconds, scoring)
    hour = F.window(F.window_time("window"), f"{rollup_seconds} seconds").alias("hour")
    totals = rows.filter(F.col("lane_id").isNull()).groupBy(hour, "camera_id").agg(
        F.avg("congestion_score").alias("average_congestion"),
        F.avg("avg_speed_kmh").alias("average_speed_kmh"),
        F.sum("vehicle_count").alias("vehicle_count"),
    )
    return totals.select(
        "camera_id",
        F.col("hour.start").alias("hour_start"),
        "average_congestion",
        "average_speed_kmh",
        "vehicle_count",
    )


def read_metrics_stream(
    spark: SparkSession, path: str, lateness_seconds: int = LATENESS_SECONDS, max_files: int | None = None
) -> DataFrame:
    """New rows of a metrics table as they are appended, with the window's start as event time."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path).withWatermark("window_start", f"{lateness_seconds} seconds")
