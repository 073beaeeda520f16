"""What a lane forecast says.

Forecasts are long rows ``(camera_id, lane_id, origin, step, ...)`` with ``step`` counting from 0 at ``origin`` plus one
step length. A series is one (camera, lane, origin); its length is the forecast horizon.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import DOWNSAMPLE_STEPS, SUMMARY_STEPS, Episode, Thresholds
from roadpulse.functions.rules import argmax, clamp, iso, level_label, level_of, plus_seconds, round_stable
from roadpulse.operators.projections import Moment, moment

SERIES = ["camera_id", "lane_id", "origin"]


def step_time(origin: Column, step: Column, step_seconds: int) -> Column:
    """Step ``i`` lies ``i + 1`` step lengths after the origin."""
    return plus_seconds(origin, (step + 1) * step_seconds)


def decode_forecast(scored: DataFrame, vehicle_count_max: float, step_seconds: int) -> DataFrame:
    """raw model output to counts, labels and times.

    ``scored`` carries ``count_norm``, ``congestion_prob`` and ``level_scores`` (one number per class).
    """
    return scored.select(
        *SERIES,
        "step",
        step_time(F.col("origin"), F.col("step"), step_seconds).alias("predicted_at"),
        (F.col("count_norm") * F.lit(float(vehicle_count_max))).alias("vehicle_count"),
        "congestion_prob",
        level_label(argmax(F.col("level_scores"))).alias("congestion_level"),
    )


def _sustained(condition: Column, steps: int, series: list[str]) -> Column:
    """True where the condition holds on this and the next ``steps - 1`` steps."""
    frame = W.partitionBy(*series).orderBy("step").rowsBetween(0, steps - 1)
    holds = F.coalesce(condition, F.lit(False)).cast("int")
    return (F.count(F.lit(1)).over(frame) == steps) & (F.min(holds).over(frame) == 1)


def first_sustained(df: DataFrame, condition: Column, steps: int, series: list[str] = SERIES) -> DataFrame:
    """first step from which the condition holds ``steps`` times in a row, NULL if it never does."""
    flagged = df.withColumn("_sustained", _sustained(condition, steps, series))
    return flagged.groupBy(*series).agg(F.min(F.when(F.col("_sustained"), F.col("step"))).alias("step"))


def episodes(forecast: DataFrame, config: Episode = Episode(), series: list[str] = SERIES) -> DataFrame:
    """when congestion starts and ends within the horizon, and how likely it is at its worst.

    All windows share the partitioning by series, so the forecast is shuffled once.
    """
    p, step = F.col("congestion_prob"), F.col("step")
    whole = W.partitionBy(*series)
    marked = forecast.select(*series, "step", "congestion_prob").withColumns(
        {
            "_rises": _sustained(p >= config.start_threshold, config.min_steps, series),
            "_falls": _sustained(p <= config.end_threshold, config.min_steps, series),
        }
    )
    marked = marked.withColumn("start_step", F.min(F.when(F.col("_rises"), step)).over(whole))
    falls_after = F.col("_falls") & (step >= F.col("start_step"))
    marked = marked.withColumn("end_step", F.min(F.when(falls_after, step)).over(whole))

    started = F.col("start_step").isNotNull()
    inside = (step >= F.col("start_step")) & (F.col("end_step").isNull() | (step < F.col("end_step")))
    peak = F.coalesce(
        F.max(F.when(~started | inside, p)),
        F.max(F.when(step == F.col("start_step"), p)),
    )
    found = marked.groupBy(*series, "start_step", "end_step").agg(peak.alias("peak_probability"))
    if "origin" not in series:
        return found
    return found.select(
        *series,
        step_time(F.col("origin"), F.col("start_step"), config.step_seconds).alias("congestion_start"),
        step_time(F.col("origin"), F.col("end_step"), config.step_seconds).alias("congestion_end"),
        "start_step",
        "end_step",
        "peak_probability",
    )


def _in_step_order(column: str) -> Column:
    """Values of a series in step order; a series is no longer than the horizon."""
    pairs = F.array_sort(F.collect_list(F.struct("step", column)))
    return F.transform(pairs, lambda pair: pair[column])


def lane_forecasts(forecast: DataFrame, config: Episode = Episode()) -> DataFrame:
    """One row per lane: its episode and its series as arrays."""
    arrays = {
        "predicted_vehicle_counts": "vehicle_count",
        "congestion_probabilities": "congestion_prob",
        "congestion_levels": "congestion_level",
        "forecast_timestamps": "predicted_at",
    }
    series = forecast.groupBy(*SERIES).agg(*[_in_step_order(c).alias(name) for name, c in arrays.items()])
    return episodes(forecast, config).join(series, SERIES)


def downsample(values: Column, step: int = DOWNSAMPLE_STEPS) -> Column:
    """every ``step``-th element of an array, beginning with the first."""
    return F.filter(values, lambda _, i: i % step == 0)


def lane_summary(forecast: DataFrame, config: Episode = Episode()) -> DataFrame:
    """the episode, the level of the first step and the mean count of the first 60 steps."""
    near = F.col("step") < SUMMARY_STEPS
    first = F.max(F.when(F.col("step") == 0, F.col("congestion_level")))
    mean = F.avg(F.when(near, F.col("vehicle_count")))
    now = forecast.groupBy(*SERIES).agg(
        F.coalesce(first, F.lit("LOW")).alias("current_congestion_level"),
        F.coalesce(round_stable(mean, 2), F.lit(0.0)).alias("next_5min_avg_count"),
    )
    found = episodes(forecast, config).drop("start_step", "end_step")
    return found.withColumnRenamed("peak_probability", "peak_congestion_probability").join(now, SERIES)


def lane_detail(
    forecast: DataFrame, camera_id: str, lane_id: int, config: Episode = Episode(), steps: int | None = None
) -> DataFrame:
    """everything about one lane, optionally only its first steps; an unknown lane is an error."""
    chosen = forecast.filter((F.col("camera_id") == camera_id) & (F.col("lane_id") == lane_id))
    if chosen.isEmpty():
        raise LookupError(f"lane {lane_id} of camera {camera_id} has no forecast")
    arrays = lane_forecasts(chosen, config).drop("peak_probability", "congestion_start", "congestion_end")
    detail = lane_summary(chosen, config).join(arrays.drop("start_step", "end_step"), SERIES)
    if steps is not None:
        names = ("predicted_vehicle_counts", "congestion_probabilities", "congestion_levels", "forecast_timestamps")
        detail = detail.withColumns({name: F.slice(name, 1, steps) for name in names})
    return detail


def congestion_outlook(
    forecast: DataFrame,
    config: Episode = Episode(),
    camera_id: str | None = None,
    lane_id: int | None = None,
    every: int = DOWNSAMPLE_STEPS,
) -> DataFrame:
    """F16: start, end and peak with the levels at every ``every``-th step."""
    if camera_id is not None:
        forecast = forecast.filter(F.col("camera_id") == camera_id)
    if lane_id is not None:
        forecast = forecast.filter(F.col("lane_id") == lane_id)
    sampled = forecast.filter(F.col("step") % every == 0)
    levels = sampled.groupBy(*SERIES).agg(_in_step_order("congestion_level").alias("predicted_levels"))
    return episodes(forecast, config).drop("start_step", "end_step").join(levels, SERIES)


def forecast_messages(forecast: DataFrame, generated_at: Moment, config: Episode = Episode()) -> DataFrame:
    """A forecast batch as JSON text, one message per (camera, lane) with the batch's size in each.

    One message for all lanes would gather every lane in one task; consumers group by ``generated_at`` instead.
    """
    made = iso(moment(generated_at))
    lanes = lane_forecasts(forecast, config)
    # Every series has a first step; counting these spares a second run of the episodes.
    count = forecast.filter(F.col("step") == 0).agg(F.count(F.lit(1)).alias("n")).scalar()
    times = F.transform(downsample(F.col("forecast_timestamps")), lambda at: iso(at))
    body = F.struct(
        "camera_id",
        "lane_id",
        made.alias("generated_at"),
        F.size("predicted_vehicle_counts").alias("forecast_horizon_steps"),
        iso(F.col("congestion_start")).alias("congestion_start"),
        iso(F.col("congestion_end")).alias("congestion_end"),
        F.round("peak_probability", 4).alias("peak_congestion_probability"),
        downsample(F.col("predicted_vehicle_counts")).alias("summary_counts"),
        downsample(F.col("congestion_probabilities")).alias("summary_probabilities"),
        downsample(F.col("congestion_levels")).alias("summary_levels"),
        times.alias("summary_timestamps"),
    )
    message = F.struct(made.alias("generated_at"), count.alias("num_lanes"), F.array(body).alias("forecasts"))
    key = F.concat_ws("/", "camera_id", F.col("lane_id").cast("string"))
    return lanes.select(key.alias("key"), F.to_json(message, {"ignoreNullFields": "false"}).alias("value"))


def camera_forecast(
    forecast: DataFrame, horizon_steps: int, thresholds: Thresholds = Thresholds()
) -> DataFrame:
    """Mean probability of a camera's lanes per step, as far as every lane reaches."""
    series = ["camera_id", "origin"]
    per_step = (
        forecast.filter(F.col("step") < horizon_steps)
        .groupBy(*series, "step")
        .agg(
            F.count(F.lit(1)).alias("lanes"),
            F.avg("congestion_prob").alias("p"),
            F.first("predicted_at").alias("predicted_at"),
        )
    )
    all_lanes = F.max("lanes").over(W.partitionBy(*series))
    score = F.round(clamp(F.col("p")), 9)
    return per_step.withColumn("_all", all_lanes).filter(F.col("lanes") == F.col("_all")).select(
        *series,
        (F.col("step") + 1).alias("step"),
        "predicted_at",
        F.round(score, 4).alias("congestion_score"),
        level_of(score, thresholds).alias("congestion_level"),
    )


def history_samples(metrics: DataFrame, as_of: Moment, minutes: int) -> DataFrame:
    """Lane rows per camera in the lookback; a camera without any gets no row and no forecast."""
    since = moment(as_of) - F.make_dt_interval(mins=F.lit(minutes))
    rows = metrics.filter(F.col("lane_id").isNotNull() & (F.col("window_start") >= since))
    return rows.groupBy("camera_id").agg(F.count(F.lit(1)).alias("history_samples"))
