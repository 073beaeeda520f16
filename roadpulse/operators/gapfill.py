"""a regular grid per lane with the last observation carried forward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import SLICE_SECONDS
from roadpulse.plans.slices import MICROS, SLICE, along, carry, future, past, time_slice

KEYS = ["camera_id", "lane_id"]
VALUES = ("vehicle_count", "avg_speed_kmh", "stopped_ratio", "congestion_score", "congestion_level")


def fill_gaps(metrics: DataFrame, step_seconds: int, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """Every step between a lane's first and last window, with missing windows and NULL values filled from before.

    Rows off the lane's grid (which starts at its first window) vanish. Each observation is repeated up to the next
    one, so no grid has to be joined; what lies beyond the borders of a time slice comes from slice summaries.
    """
    step = step_seconds * MICROS
    rows = metrics.select(*KEYS, "window_start", *VALUES)
    rows = rows.withColumn(SLICE, time_slice(F.col("window_start"), slice_seconds))
    anchored = carry(
        rows,
        KEYS,
        summary={"first": F.min("window_start")},
        carried={"_origin": F.first("first").over(along(KEYS).rowsBetween(W.unboundedPreceding, 0))},
    )
    offset = F.unix_micros("window_start") - F.unix_micros("_origin")
    on_grid = anchored.filter(F.pmod(offset, F.lit(step)) == 0).drop("_origin")

    known = {c: F.max_by(c, F.when(F.col(c).isNotNull(), F.col("window_start"))) for c in VALUES}
    carried = carry(
        on_grid,
        KEYS,
        summary={"first": F.min("window_start")} | known,
        carried={"_next_slice": F.first("first").over(future(KEYS))}
        | {f"_past_{c}": F.last(c, ignorenulls=True).over(past(KEYS)) for c in VALUES},
    )
    order = W.partitionBy(*KEYS, SLICE).orderBy("window_start")
    so_far = order.rowsBetween(W.unboundedPreceding, 0)
    filled = carried.select(
        *KEYS,
        "window_start",
        *[F.coalesce(F.last(c, ignorenulls=True).over(so_far), f"_past_{c}").alias(c) for c in VALUES],
        F.coalesce(F.lead("window_start").over(order), "_next_slice").alias("_next"),
    )
    return _repeat(filled, step, slice_seconds * MICROS)


def _repeat(filled: DataFrame, step: int, piece: int) -> DataFrame:
    """One row per step up to the next observation, in pieces so that a long silence makes no huge array."""
    piece = max(piece - piece % step, step)
    first = F.unix_micros("window_start")
    last = F.coalesce(F.unix_micros("_next") - F.lit(step), first)
    pieces = F.sequence(first, last, F.lit(piece).cast("long"))
    by_piece = filled.withColumns({"_last": last, "_piece": F.explode(pieces)})
    until = F.least(F.col("_piece") + F.lit(piece - step), "_last")
    steps = F.sequence("_piece", until, F.lit(step).cast("long"))
    return by_piece.withColumn("_at", F.explode(steps)).select(
        *KEYS, F.timestamp_micros("_at").alias("window_start"), *VALUES
    )
