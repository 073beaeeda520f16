"""Windows that late detections open again, and alerts that follow them.

``stream_metrics`` lets a window out once and drops what comes later. Here each batch adds what its vehicles say to a table of
sums per (window, camera, lane, vehicle), works out the windows it has touched from all sums of these windows, late or
not, and upserts them into the table of metrics. Of the cameras it has touched, the alerts are worked out again from the
last quiet window before the first change, and what was told before and no longer holds is retracted.

All three are tables of versions (B2) with one commit per batch and table. A batch that is stopped and comes again replaces
its own commits and works out the same rows. Nothing is kept in state, and a batch reads only its own dates.
"""

from __future__ import annotations

from datetime import date, timedelta
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roadpulse.config import VEHICLE_CLASSES, WINDOW_SECONDS, Scoring
from roadpulse.functions.rules import severity_of
from roadpulse.operators.alerts import alerts_from_metrics
from roadpulse.operators.projections import camera_wide
from roadpulse.operators.windows import METRIC_COLUMNS, add_vehicles, vehicle_rows
from roadpulse.schemas import ALERT
from roadpulse.streaming.sinks import start
from roadpulse.streaming.upserts import Kind, dates_of, log_batch, read_dates, read_upserted

_VEHICLE_KEY = ("camera_id", "lane_id", "vehicle_id", "window_start", "window_end")
_SUMS = {**{f"_n_{name}": T.LongType() for name in VEHICLE_CLASSES}, "_speed_sum": T.DoubleType(), "_speed_n": T.LongType(), "_stopped_n": T.LongType()}
_KEY_TYPES = (T.StringType(), T.IntegerType(), T.StringType(), T.TimestampType(), T.TimestampType())


def _added(log: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in _SUMS]
    return log.groupBy(*_VEHICLE_KEY, "date").agg(*sums, F.max("batch").alias("batch"))


def _latest(log: DataFrame) -> DataFrame:
    columns = [c for c in _ALERT_COLUMNS if c != "alert_id"]
    newest = F.max_by(F.struct("batch", *columns), "batch").alias("row")
    return log.groupBy("alert_id", "date").agg(newest).select("alert_id", "date", "row.*")


VEHICLES = Kind(
    T.StructType([*map(T.StructField, _VEHICLE_KEY, _KEY_TYPES), *map(T.StructField, _SUMS, _SUMS.values())]), "window_start", _added
)
_ALERT_COLUMNS = (*ALERT.fieldNames(), "retracted")
ALERTS = Kind(T.StructType([*ALERT.fields, T.StructField("retracted", T.BooleanType())]), "triggered_at", _latest)


def split_by_age(events: DataFrame, newest: date, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows that may still change a window, and those of dates more than ``days`` before the newest."""
    border = F.lit((newest - timedelta(days=days)).isoformat()).cast("date")
    return events.filter(F.to_date("ts") >= border), events.filter(F.to_date("ts") < border)


def reopen_windows(
    events: DataFrame, tables: str, batch_id: int, days: int, seconds: int = WINDOW_SECONDS, scoring: Scoring = Scoring()
) -> DataFrame | None:
    """Take a batch into the sums and upsert the windows it has touched; (camera_id, window_start) of these, None if none.

    Dates more than ``days`` before the newest that the table has seen are closed: their rows are refused.
    """
    spark = events.sparkSession
    found = [r["date"] for r in events.select(F.to_date("ts").alias("date")).distinct().collect() if r["date"]]
    known = [date.fromisoformat(d) for d in dates_of(spark, f"{tables}/vehicles")]
    if not found:
        return None
    accepted, _ = split_by_age(events, max(found + known), days)
    sums = vehicle_rows(accepted, seconds).select("*", F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"))
    log_batch(sums, f"{tables}/vehicles", batch_id, VEHICLES)
    touched = accepted.select("camera_id", F.window("ts", f"{seconds} seconds")["start"].alias("window_start")).distinct()
    edges = touched.select(F.to_date("window_start").alias("date")).distinct()
    held = read_dates(spark, f"{tables}/vehicles", [str(r["date"]) for r in edges.collect()], VEHICLES)
    again = held.join(touched, ["camera_id", "window_start"], "left_semi")
    again = again.withColumn("window", F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")))
    log_batch(add_vehicles(again, scoring).select(*METRIC_COLUMNS), f"{tables}/metrics", batch_id)
    return touched


def correct_alerts(touched: DataFrame, registry: DataFrame, tables: str, batch_id: int) -> None:
    """Work out the alerts that the touched windows may change; those that no longer hold come out as retracted.

    A run of HIGH or SEVERE windows can't reach over a quiet one, so that what lies before the last quiet window before a
    camera's first touched one stays as it is. Of each camera, only windows and alerts from there on are compared.
    """
    spark = touched.sparkSession
    first = touched.groupBy("camera_id").agg(F.min("window_start").alias("_first"))
    metrics = camera_wide(read_upserted(spark, f"{tables}/metrics")).join(first, "camera_id")
    quiet = severity_of(F.col("congestion_level")).isNull() & (F.col("window_start") < F.col("_first"))
    since = metrics.groupBy("camera_id").agg(F.max(F.when(quiet, F.col("window_start"))).alias("_since"))
    region = metrics.join(since, "camera_id").filter(F.col("_since").isNull() | (F.col("window_start") >= F.col("_since")))
    now = alerts_from_metrics(region.select(*METRIC_COLUMNS), registry).withColumn("retracted", F.lit(False))
    told = read_upserted(spark, f"{tables}/alerts", kind=ALERTS).filter(~F.col("retracted")).join(since, "camera_id")
    told = told.filter(F.col("_since").isNull() | (F.col("triggered_at") > F.col("_since"))).select(*_ALERT_COLUMNS)
    gone = told.join(now.select("alert_id"), "alert_id", "left_anti").withColumn("retracted", F.lit(True))
    held = told.select(*[F.col(c).alias(f"_{c}") for c in _ALERT_COLUMNS])
    same = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in _ALERT_COLUMNS])
    changed = now.join(held, F.col("alert_id") == F.col("_alert_id"), "left").filter(F.col("_alert_id").isNull() | ~same)
    log_batch(changed.select(*_ALERT_COLUMNS).unionByName(gone.select(*_ALERT_COLUMNS)), f"{tables}/alerts", batch_id, ALERTS)


def stream_late_windows(
    events: DataFrame,
    registry: DataFrame,
    tables: str,
    checkpoint: str,
    days: int = 1,
    every: str | None = "5 seconds",
    seconds: int = WINDOW_SECONDS,
    scoring: Scoring = Scoring(),
) -> StreamingQuery:
    """Keep ``<tables>/vehicles``, ``/metrics`` and ``/alerts`` up to date with a stream of raw events."""

    def take(rows: DataFrame, batch_id: int) -> None:
        rows.persist()
        touched = reopen_windows(rows, tables, batch_id, days, seconds, scoring)
        if touched is not None:
            correct_alerts(touched, registry, tables, batch_id)
        rows.unpersist()

    return start(events.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint), every)


def read_late_metrics(spark: SparkSession, tables: str) -> DataFrame:
    """The windows as all detections so far have them."""
    return read_upserted(spark, f"{tables}/metrics").drop("date")


def read_late_alerts(spark: SparkSession, tables: str) -> DataFrame:
    """The alerts that hold now."""
    return read_upserted(spark, f"{tables}/alerts", kind=ALERTS).filter(~F.col("retracted")).drop("date", "retracted")
