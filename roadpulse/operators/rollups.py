"""E8-E13 from a maintained roll-up: one row of sums per camera and hour, which an upsert corrects by differences.

A row of metrics adds its share to its hour; when an upsert replaces the row, the old share is taken back. Sums are decimals,
so that taking back leaves no rounding noise. Answers are for whole hours, ``[start, end)``, and read the roll-up alone.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.config import SEVERE_ROW_MINUTES
from roadpulse.functions.rules import round_stable
from roadpulse.operators.analytics import SUMMARY, share, summaries, with_segment
from roadpulse.operators.projections import between, camera_wide

KEY = ("camera_id", "hour_start")
#: Sums of metric rows, exact: scores have four decimals, speeds two, counts none.
SHARES = {
    "score_sum": ("congestion_score", T.DecimalType(28, 4)), "score_n": None,
    "speed_sum": ("avg_speed_kmh", T.DecimalType(28, 2)), "speed_n": None,
    "vehicles": ("vehicle_count", T.LongType()), "high": None, "severe": None,
    "queue_sum": ("queue_length", T.LongType()), "queue_n": None, "windows": None,
}


def share_type(name: str) -> T.DataType:
    return SHARES[name][1] if SHARES[name] else T.LongType()


def hour_shares(metrics: DataFrame) -> DataFrame:
    """What camera-wide rows add to their hours."""
    ones = {
        "score_n": F.col("congestion_score").isNotNull(), "speed_n": F.col("avg_speed_kmh").isNotNull(),
        "queue_n": F.col("queue_length").isNotNull(), "high": F.col("congestion_level") == "HIGH",
        "severe": F.col("congestion_level") == "SEVERE", "windows": F.lit(True),
    }
    sums = [
        (F.coalesce(F.sum(F.col(of[0]).cast(of[1])), F.lit(0)) if of else F.count_if(ones[name])).cast(share_type(name)).alias(name)
        for name, of in SHARES.items()
    ]
    return camera_wide(metrics).groupBy("camera_id", F.date_trunc("hour", "window_start").alias("hour_start")).agg(*sums)


def add_shares(shares: DataFrame, *keys: str) -> DataFrame:
    """Add up shares of one (camera, hour)."""
    sums = [F.sum(name).cast(share_type(name)).alias(name) for name in SHARES]
    return shares.groupBy(*KEY, *keys).agg(*sums)


def share_changes(replaced: DataFrame, rows: DataFrame) -> DataFrame:
    """What an upsert changes: the shares of ``rows`` less those of the rows they replace. Hours without a change are left out."""
    back = hour_shares(replaced).select(*KEY, *[(-F.col(name)).alias(name) for name in SHARES])
    changed = add_shares(hour_shares(rows).unionByName(back))
    return changed.filter(F.greatest(*[F.abs(name) for name in SHARES]) > 0)


def whole_hours(start: datetime, end: datetime) -> tuple[datetime, datetime]:
    for bound in (start, end):
        if bound.minute or bound.second or bound.microsecond:
            raise ValueError(f"{bound} is not a whole hour")
    return start, end


def _within(start: datetime, end: datetime) -> Column:
    start, end = whole_hours(start, end)
    return between(F.col("hour_start"), start, end, closed=False)


def _by_hour_of_day(rollup: DataFrame, ranges: dict[str, Column]) -> DataFrame:
    """The sums that ``summaries`` takes, per hour of day and once for each named condition."""
    sums = []
    for name, holds in ranges.items():
        pick = lambda c, holds=holds: F.coalesce(F.sum(F.when(holds, c)), F.lit(0))
        sums += [
            pick(F.col("score_sum")).cast("double").alias(f"{name}_score_sum"),
            pick(F.col("score_n")).alias(f"{name}_score_n"),
            pick(F.col("speed_sum")).cast("double").alias(f"{name}_speed_sum"),
            pick(F.col("speed_n")).alias(f"{name}_speed_n"),
            pick(F.col("vehicles")).alias(f"{name}_vehicles"),
            pick(F.col("high") + F.col("severe")).alias(f"{name}_incidents"),
            pick(F.col("windows")).alias(f"{name}_rows"),
        ]
    return rollup.groupBy(F.hour("hour_start").alias("hour")).agg(*sums)


def range_summary(rollup: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """E8, E9."""
    held = rollup.filter(_within(start, end))
    return summaries(_by_hour_of_day(held, {"all": F.lit(True)}), ["all"]).select("all.*")


def compare_ranges(rollup: DataFrame, range_a: tuple[datetime, datetime], range_b: tuple[datetime, datetime]) -> DataFrame:
    """Both summaries from one scan; the ranges may overlap."""
    in_a, in_b = _within(*range_a), _within(*range_b)
    both = summaries(_by_hour_of_day(rollup.filter(in_a | in_b), {"a": in_a, "b": in_b}), ["a", "b"])
    return both.select(*[F.col(f"{name}.{field}").alias(f"{name}_{field}") for name in ("a", "b") for field in SUMMARY])


def incident_summary(rollup: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """E10."""
    return rollup.filter(_within(start, end)).agg(
        share(F.sum("score_sum").cast("double"), F.sum("score_n")).alias("average_congestion"),
        F.coalesce(F.sum(F.col("high") + F.col("severe")), F.lit(0)).alias("total_incidents"),
        F.coalesce(F.sum("high"), F.lit(0)).alias("high"),
        F.coalesce(F.sum("severe"), F.lit(0)).alias("critical"),
    )


def hourly_trends(rollup: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """E11."""
    hours = rollup.filter(_within(start, end) & (F.col("windows") > 0)).groupBy(F.hour("hour_start").alias("hour"))
    return hours.agg(
        share(F.sum("score_sum").cast("double"), F.sum("score_n")).alias("average_congestion"),
        share(F.sum("speed_sum").cast("double"), F.sum("speed_n")).alias("average_speed_kmh"),
        F.coalesce(F.sum("vehicles"), F.lit(0)).alias("vehicle_count"),
    ).orderBy("hour")


def top_segments(rollup: DataFrame, registry: DataFrame, start: datetime, end: datetime, k: int = 10) -> DataFrame:
    """E12."""
    names = ("score_sum", "score_n", "queue_sum", "queue_n", "high", "severe", "windows")
    held = rollup.filter(_within(start, end)).groupBy("camera_id").agg(*[F.sum(c).alias(c) for c in names]).filter("windows > 0")
    per_segment = with_segment(held, registry).groupBy("segment_key").agg(*[F.sum(c).alias(c) for c in names])
    ranked = per_segment.select(
        "segment_key",
        share(F.col("score_sum").cast("double"), "score_n").alias("average_congestion"),
        (F.col("severe") * SEVERE_ROW_MINUTES).alias("severe_minutes"),
        share("queue_sum", "queue_n").alias("average_queue_length"),
        (F.col("high") + F.col("severe")).alias("incident_count"),
    )
    mean = round_stable(F.col("average_congestion"), 9)
    return ranked.orderBy(mean.desc(), F.desc("severe_minutes"), "segment_key").limit(k)
