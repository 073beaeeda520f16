"""Short-term forecast of the congestion score from a smoothed level and a linear trend."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import SLICE_SECONDS, Thresholds
from roadpulse.functions.rules import clamp, level_of, round_stable
from roadpulse.plans.slices import SLICE, future, time_slice


def _by_slice(scores: DataFrame, alpha: float, lookback: int, slice_seconds: int) -> DataFrame:
    """One row per (camera, slice): its weighted sum, its length, its first score and its last few scores.

    ``after`` counts the samples of later slices: it shifts the weights of a slice to their place in the whole
    series. With ``decay = 1 - alpha`` the level of a series is the sum of ``alpha * decay^age * score`` plus
    ``decay^n`` times the first score.
    """
    rows = scores.select("camera_id", "window_start", F.col("congestion_score").alias("score"))
    rows = rows.filter(F.col("score").isNotNull())
    rows = rows.withColumn(SLICE, time_slice(F.col("window_start"), slice_seconds))
    age = F.row_number().over(W.partitionBy("camera_id", SLICE).orderBy(F.desc("window_start"))) - 1
    weighted = F.lit(alpha) * F.pow(F.lit(1 - alpha), F.col("age")) * F.col("score")
    tail = F.collect_list(F.when(F.col("age") < lookback, F.struct("age", "score")))
    slices = rows.withColumn("age", age).groupBy("camera_id", SLICE).agg(
        F.sum(weighted).alias("weighted"),
        F.count(F.lit(1)).alias("n"),
        F.max_by("score", "age").alias("first_score"),
        tail.alias("tail"),
    )
    after = F.coalesce(F.sum("n").over(future(["camera_id"])), F.lit(0))
    return slices.withColumn("after", after)


def ewma(scores: DataFrame, alpha: float = 0.4, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """exponentially weighted level of each camera's whole series, seeded with its first score."""
    return _levels(_by_slice(scores, alpha, 1, slice_seconds), alpha)


def _levels(slices: DataFrame, alpha: float) -> DataFrame:
    decay = F.lit(1 - alpha)
    return slices.groupBy("camera_id").agg(
        (
            F.sum(F.col("weighted") * F.pow(decay, F.col("after")))
            + F.min_by("first_score", SLICE) * F.pow(decay, F.sum("n"))
        ).alias("level")
    )


def trend(scores: DataFrame, lookback: int = 6, slice_seconds: int = SLICE_SECONDS) -> DataFrame:
    """least-squares slope per step over the last ``lookback`` scores; 0 for fewer than two."""
    return _slopes(_by_slice(scores, 0.5, lookback, slice_seconds), lookback)


def _slopes(slices: DataFrame, lookback: int) -> DataFrame:
    last = (
        slices.filter(F.col("after") < lookback)
        .select("camera_id", "after", F.explode("tail").alias("sample"))
        .withColumn("age", F.col("after") + F.col("sample.age"))
        .filter(F.col("age") < lookback)
    )
    slope = F.regr_slope(F.col("sample.score"), (-F.col("age")).cast("double"))
    return last.groupBy("camera_id").agg(F.coalesce(slope, F.lit(0.0)).alias("slope"))


def ewma_forecast(
    scores: DataFrame,
    horizon: int = 6,
    lookback: int = 6,
    alpha: float = 0.4,
    thresholds: Thresholds = Thresholds(),
    roster: DataFrame | None = None,
    slice_seconds: int = SLICE_SECONDS,
) -> DataFrame:
    """``horizon`` projected scores per camera with their levels.

    Cameras of the optional ``roster`` without any history get zeros and LOW; a horizon of 0 gives no rows.
    """
    slices = _by_slice(scores, alpha, lookback, slice_seconds)
    state = _levels(slices, alpha).join(_slopes(slices, lookback), "camera_id")
    if roster is not None:
        state = roster.select("camera_id").distinct().join(state, "camera_id", "left")
    step = F.explode(F.sequence(F.lit(1), F.lit(horizon)) if horizon > 0 else F.array().cast("array<int>"))
    projected = F.coalesce(clamp(F.col("level") + F.col("slope") * F.col("step")), F.lit(0.0))
    return (
        state.withColumn("step", step)
        .withColumn("projected", projected)
        .select(
            "camera_id",
            "step",
            round_stable(F.col("projected"), 4).alias("congestion_score"),
            level_of(F.round("projected", 9), thresholds).alias("congestion_level"),
        )
    )
