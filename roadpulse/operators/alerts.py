"""Alerts that open, update and resolve themselves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import PUSH_ALERT_LEVELS, SLICE_SECONDS
from roadpulse.functions.rules import alert_message, alert_title, iso, severity_of
from roadpulse.operators.projections import camera_wide, filter_alerts
from roadpulse.plans.slices import SLICE, along, carry, past, time_slice
from roadpulse.schemas import ALERT

# Fixed value: order of the columns in an alert export.
EXPORT_COLUMNS = (
    "alert_id",
    "camera_id",
    "road_segment",
    "alert_type",
    "severity",
    "title",
    "message",
    "triggered_at",
    "resolved_at",
    "congestion_level",
    "congestion_score",
    "acknowledged",
    "acknowledged_by",
    "acknowledged_at",
)


def alerts_from_metrics(
    metrics: DataFrame, registry: DataFrame, slice_seconds: int = SLICE_SECONDS
) -> DataFrame:
    """One alert per unbroken run of HIGH/SEVERE camera-wide windows of a camera.

    It opens at the end of the run's first window, shows the level and score of the run's last window, and resolves
    at the end of the first window after the run. Runs are found within time slices; each slice hands on only
    whether it ended inside a run and when the last run began.
    """
    keys = ["camera_id"]
    alerting = F.col("_severity").isNotNull()
    order = W.partitionBy("camera_id", SLICE).orderBy("window_start")
    rows = camera_wide(metrics).select(
        "camera_id",
        "window_start",
        "window_end",
        "congestion_level",
        "congestion_score",
        severity_of(F.col("congestion_level")).alias("_severity"),
        time_slice(F.col("window_start"), slice_seconds).alias(SLICE),
    )
    rows = rows.withColumn("_before", F.lag(alerting).over(order))
    first_of_slice = alerting & F.col("_before").isNull()
    began = alerting & (F.col("_before") == F.lit(False))
    placed = carry(
        rows,
        keys,
        summary={
            "ends_in_run": F.max_by(alerting, "window_start"),
            "opens_at": F.max(F.when(first_of_slice, F.col("window_start"))),
            "last_start": F.max(F.when(began, F.col("window_start"))),
        },
        prepared={"earlier_run": F.coalesce(F.lag("ends_in_run").over(along(keys)), F.lit(False))},
        carried={
            "_earlier_run": F.col("earlier_run"),
            "_run_before": F.last(
                F.coalesce("last_start", F.when(~F.col("earlier_run"), F.col("opens_at"))), ignorenulls=True
            ).over(past(keys)),
        },
    )
    before = F.coalesce("_before", "_earlier_run")
    # A run is named by the start of its first window. Rows later in the slice look back to it; rows of later
    # slices get it from the last slice in which a run began.
    began_here = F.last(F.when(alerting & ~before, F.col("window_start")), ignorenulls=True)
    named = placed.withColumns({"_ends": ~alerting & before, "_run_here": began_here.over(order)})
    named = named.filter(alerting | F.col("_ends"))
    run = F.coalesce("_run_here", "_run_before")
    shown = F.struct("_severity", "congestion_level", "congestion_score")
    alerts = (
        named.groupBy("camera_id", run.alias("_run"))
        .agg(
            F.min(F.when(alerting, F.col("window_end"))).alias("triggered_at"),
            F.max(F.when(F.col("_ends"), F.col("window_end"))).alias("resolved_at"),
            F.max_by(shown, F.when(alerting, F.col("window_start"))).alias("shown"),
        )
        .select("camera_id", "triggered_at", "resolved_at", "shown.*")
    )
    return describe(with_alert_segment(alerts, registry))


def with_alert_segment(alerts: DataFrame, registry: DataFrame) -> DataFrame:
    """A registered camera's segment, even if NULL; the camera itself when it is not registered."""
    known = registry.select("camera_id", F.struct("road_segment").alias("_registered"))
    segment = F.when(F.col("_registered").isNotNull(), F.col("_registered.road_segment")).otherwise(F.col("camera_id"))
    return alerts.join(known, "camera_id", "left").withColumn("road_segment", segment).drop("_registered")


def describe(alerts: DataFrame, *extra: Column) -> DataFrame:
    """Alert rows from ``(camera_id, road_segment, _severity, level, score, triggered_at, resolved_at)``."""
    camera, severity = F.col("camera_id"), F.col("_severity")
    described = alerts.select(
        *extra,
        alert_id(camera, F.col("triggered_at")).alias("alert_id"),
        "camera_id",
        "road_segment",
        F.lit("CONGESTION").alias("alert_type"),
        severity.alias("severity"),
        alert_title(severity).alias("title"),
        alert_message(severity, camera, F.col("resolved_at").isNotNull()).alias("message"),
        "congestion_level",
        "congestion_score",
        "triggered_at",
        "resolved_at",
        F.lit(None).cast("string").alias("acknowledged_by"),
        F.lit(None).cast("timestamp").alias("acknowledged_at"),
        F.to_json(F.struct(F.lit("writer").alias("source"), camera.alias("camera_id"))).alias("payload"),
    )
    return described.select(*ALERT.fieldNames(), *described.columns[: len(extra)])


def alert_id(camera_id: Column, triggered_at: Column) -> Column:
    """A camera has one open alert at a time, so its opening time names it, in batch and stream alike."""
    return F.concat(camera_id, F.lit("@"), F.date_format(triggered_at, "yyyyMMdd'T'HHmmss"))


def alert_history(alerts: DataFrame, **options) -> DataFrame:
    """Filtered alerts, newest first, with the derived ``acknowledged`` flag."""
    chosen = filter_alerts(alerts, **options)
    return chosen.withColumn("acknowledged", F.col("acknowledged_at").isNotNull()).orderBy(F.desc("triggered_at"))


def unacknowledged(alerts: DataFrame) -> DataFrame:
    """Alerts nobody has acknowledged, resolved or not, newest first."""
    return alert_history(alerts.filter(F.col("acknowledged_at").isNull()))


def unresolved(alerts: DataFrame) -> DataFrame:
    """Alerts whose congestion still lasts, acknowledged or not."""
    return alerts.filter(F.col("resolved_at").isNull())


def _first_acks(acks: DataFrame) -> DataFrame:
    first = F.min(F.struct("acknowledged_at", "ack_id", "admin_id")).alias("_ack")
    return acks.groupBy("alert_id").agg(first)


def acknowledge(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """K3: the first acknowledgement wins, and one already on the alert stays."""
    acked = F.col("acknowledged_at").isNotNull()
    merged = {
        "acknowledged_by": F.when(acked, F.col("acknowledged_by")).otherwise(F.col("_ack.admin_id")),
        "acknowledged_at": F.coalesce("acknowledged_at", "_ack.acknowledged_at"),
    }
    return alerts.join(_first_acks(acks), "alert_id", "left").withColumns(merged).select(*alerts.columns)


def ack_results(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """K3: what became of each request: acknowledged, already_acknowledged or not_found."""
    held = alerts.select(
        "alert_id",
        F.lit(True).alias("_known"),
        F.col("acknowledged_by").alias("_held_by"),
        F.col("acknowledged_at").alias("_held_at"),
    )
    # Left, as a request without an id has no first one; it ends as not_found.
    joined = acks.join(_first_acks(acks), "alert_id", "left").join(held, "alert_id", "left")
    already = F.col("_held_at").isNotNull() | (F.col("_ack.ack_id") != F.col("ack_id"))
    holder = F.when(F.col("_held_at").isNotNull(), F.coalesce("_held_by", "admin_id")).otherwise(F.col("_ack.admin_id"))
    holds = F.col("_known").isNotNull()
    return joined.select(
        "ack_id",
        "alert_id",
        F.when(holds, holder).alias("admin_id"),
        F.when(holds, F.coalesce("_held_at", "_ack.acknowledged_at")).alias("acknowledged_at"),
        F.when(~holds, "not_found").when(already, "already_acknowledged").otherwise("acknowledged").alias("status"),
    )


def new_alerts(metrics: DataFrame) -> DataFrame:
    """One push per (camera, window) whose level is HIGH or worse. On a stream, set the watermark first."""
    loud = camera_wide(metrics).filter(F.col("congestion_level").isin(*PUSH_ALERT_LEVELS))
    once = loud.dropDuplicatesWithinWatermark if loud.isStreaming else loud.dropDuplicates
    return once(["camera_id", "window_start"]).select(
        "camera_id",
        F.col("congestion_level").alias("severity"),
        F.coalesce("congestion_score", F.lit(0.0)).alias("score"),
        F.coalesce("vehicle_count", F.lit(0)).alias("vehicle_count"),
        "window_start",
        "window_end",
    )


def alert_export(alerts: DataFrame, **options) -> DataFrame:
    """The rows of an alert export, times as ISO text and missing times as empty text."""
    rows = alert_history(alerts, **options)
    times = {c: F.coalesce(iso(F.col(c)), F.lit("")) for c in ("triggered_at", "resolved_at", "acknowledged_at")}
    return rows.withColumns(times).select(*EXPORT_COLUMNS)


def export_alerts_csv(alerts: DataFrame, path: str, **options) -> None:
    """Write the export as CSV with a header; every file of the folder carries it."""
    alert_export(alerts, **options).write.csv(path, header=True, emptyValue="", nullValue="", mode="errorifexists")
