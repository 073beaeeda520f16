"""Figures over a period, from camera-wide rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadpulse.config import SEVERE_ROW_MINUTES
from roadpulse.functions.rules import incident_flag, round_stable
from roadpulse.operators.projections import Moment, between, camera_wide, in_range

SUMMARY = ("average_congestion", "vehicle_count", "average_speed_kmh", "incident_count", "peak_hour")


def with_segment(metrics: DataFrame, registry: DataFrame) -> DataFrame:
    """Every row with its road segment, or its camera when it has none."""
    segments = registry.select("camera_id", "road_segment")
    return metrics.join(segments, "camera_id", "left").withColumn(
        "segment_key", F.coalesce("road_segment", "camera_id")
    )


def share(total: str | Column, n: str | Column) -> Column:
    total, n = (F.col(c) if isinstance(c, str) else c for c in (total, n))
    return F.coalesce(F.try_divide(total, n), F.lit(0.0))


def _hourly_totals(rows: DataFrame, ranges: dict[str, Column]) -> DataFrame:
    """Totals per hour of day (24 rows), once for each named condition."""
    aggregates = []
    for name, holds in ranges.items():
        pick = lambda c, holds=holds: F.when(holds, c)
        aggregates += [
            F.sum(pick(F.col("congestion_score"))).alias(f"{name}_score_sum"),
            F.count(pick(F.col("congestion_score"))).alias(f"{name}_score_n"),
            F.sum(pick(F.col("avg_speed_kmh"))).alias(f"{name}_speed_sum"),
            F.count(pick(F.col("avg_speed_kmh"))).alias(f"{name}_speed_n"),
            F.sum(pick(F.col("vehicle_count"))).alias(f"{name}_vehicles"),
            F.sum(pick(incident_flag(F.col("congestion_level")))).alias(f"{name}_incidents"),
            F.count_if(holds).alias(f"{name}_rows"),
        ]
    return rows.groupBy(F.hour("window_start").alias("hour")).agg(*aggregates)


def summaries(hourly: DataFrame, names: list[str]) -> DataFrame:
    """One row with a summary struct per name. Of equally congested hours the earliest is the peak."""
    structs = []
    for name in names:
        mean = share(f"{name}_score_sum", f"{name}_score_n")
        rank = F.when(F.col(f"{name}_rows") > 0, F.struct(F.round(mean, 9), -F.col("hour")))
        structs.append(
            F.struct(
                share(F.sum(f"{name}_score_sum"), F.sum(f"{name}_score_n")).alias("average_congestion"),
                F.coalesce(F.sum(f"{name}_vehicles"), F.lit(0)).alias("vehicle_count"),
                share(F.sum(f"{name}_speed_sum"), F.sum(f"{name}_speed_n")).alias("average_speed_kmh"),
                F.coalesce(F.sum(f"{name}_incidents"), F.lit(0)).alias("incident_count"),
                F.max_by("hour", rank).alias("peak_hour"),
            ).alias(name)
        )
    return hourly.agg(*structs)


def range_summary(
    metrics: DataFrame, start: Moment | None, end: Moment | None, as_of: Moment | None = None
) -> DataFrame:
    """One row of totals and the hour of day with the highest mean score; zeros when nothing happened."""
    rows = in_range(camera_wide(metrics), start, end, as_of)
    hourly = _hourly_totals(rows, {"all": F.lit(True)})
    return summaries(hourly, ["all"]).select("all.*")


def peak_hour(metrics: DataFrame, start: Moment | None, end: Moment | None, as_of: Moment | None = None) -> DataFrame:
    """E9 alone."""
    return range_summary(metrics, start, end, as_of).select("peak_hour")


def compare_ranges(
    metrics: DataFrame, range_a: tuple[Moment, Moment], range_b: tuple[Moment, Moment]
) -> DataFrame:
    """Both summaries and B minus A, from a single scan; the ranges may overlap."""
    in_a, in_b = (between(F.col("window_start"), *bounds) for bounds in (range_a, range_b))
    rows = camera_wide(metrics).filter(in_a | in_b)
    both = summaries(_hourly_totals(rows, {"a": in_a, "b": in_b}), ["a", "b"])
    deltas = {
        "congestion_delta": "average_congestion",
        "vehicle_count_delta": "vehicle_count",
        "speed_delta": "average_speed_kmh",
        "incident_delta": "incident_count",
    }
    return both.select(
        *[F.col(f"{name}.{field}").alias(f"{name}_{field}") for name in ("a", "b") for field in SUMMARY],
        *[(F.col(f"b.{field}") - F.col(f"a.{field}")).alias(delta) for delta, field in deltas.items()],
    )


def incident_summary(
    metrics: DataFrame, start: Moment | None, end: Moment | None, as_of: Moment | None = None
) -> DataFrame:
    """How many windows were HIGH or worse, with the mean score of the period."""
    level = F.col("congestion_level")
    return in_range(camera_wide(metrics), start, end, as_of).agg(
        F.coalesce(F.avg("congestion_score"), F.lit(0.0)).alias("average_congestion"),
        F.count_if(level.isin("HIGH", "SEVERE")).alias("total_incidents"),
        F.count_if(level == "HIGH").alias("high"),
        F.count_if(level == "SEVERE").alias("critical"),
    )


def hourly_trends(
    metrics: DataFrame, start: Moment | None, end: Moment | None, as_of: Moment | None = None
) -> DataFrame:
    """Figures by hour of day (UTC)."""
    rows = in_range(camera_wide(metrics), start, end, as_of)
    hourly = rows.groupBy(F.hour("window_start").alias("hour")).agg(
        F.coalesce(F.avg("congestion_score"), F.lit(0.0)).alias("average_congestion"),
        F.coalesce(F.avg("avg_speed_kmh"), F.lit(0.0)).alias("average_speed_kmh"),
        F.coalesce(F.sum("vehicle_count"), F.lit(0)).alias("vehicle_count"),
    )
    return hourly.orderBy("hour")


def top_segments(
    metrics: DataFrame,
    registry: DataFrame,
    start: Moment | None,
    end: Moment | None,
    k: int = 10,
    as_of: Moment | None = None,
) -> DataFrame:
    """The ``k`` most congested segments.

    Rows are added up per camera before the registry is joined, so the join sees one row per camera.
    """
    severe = F.when(F.col("congestion_level") == "SEVERE", SEVERE_ROW_MINUTES).otherwise(0)
    totals = {
        "_score_sum": F.sum("congestion_score"),
        "_score_n": F.count("congestion_score"),
        "_queue_sum": F.sum("queue_length"),
        "_queue_n": F.count("queue_length"),
        "severe_minutes": F.sum(severe),
        "incident_count": F.sum(incident_flag(F.col("congestion_level"))),
    }
    per_camera = (
        in_range(camera_wide(metrics), start, end, as_of)
        .groupBy("camera_id")
        .agg(*[agg.alias(name) for name, agg in totals.items()])
    )
    per_segment = with_segment(per_camera, registry).groupBy("segment_key").agg(
        *[F.sum(name).alias(name) for name in totals]
    )
    ranked = per_segment.select(
        "segment_key",
        share("_score_sum", "_score_n").alias("average_congestion"),
        "severe_minutes",
        share("_queue_sum", "_queue_n").alias("average_queue_length"),
        "incident_count",
    )
    # Equal means may differ by rounding noise of a distributed sum, which must not decide.
    mean = round_stable(F.col("average_congestion"), 9)
    return ranked.orderBy(mean.desc(), F.desc("severe_minutes"), "segment_key").limit(k)
