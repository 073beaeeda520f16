"""Keyed changes and retention as DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import Retention, Scoring, Thresholds
from roadpulse.functions.rules import congestion_score, level_between
from roadpulse.operators.projections import Moment, moment
from roadpulse.operators.windows import METRIC_COLUMNS
from roadpulse.plans.slices import SLICE, carry, past, slice_start

METRIC_KEY = ["camera_id", "lane_id", "window_start"]
CAMERA_FIELDS = ("name", "latitude", "longitude", "road_segment", "description")
# Longest allowed texts.
MAX_LENGTH = {"camera_id": 200, "name": 200, "road_segment": 500, "description": 2000}


# --- metrics table -------------------------------------------------------------------------------------------------


def upsert_metrics(existing: DataFrame, updates: DataFrame, version: str | None = None) -> DataFrame:
    """B2: rows of ``updates`` replace rows with the same (camera, lane, window); a NULL lane is one value.

    Grouping, unlike a join, treats NULL keys as equal. ``version`` names a column of ``updates`` that orders
    repeated updates of one key. Both inputs combine on the map side.
    """
    older = existing.select(*METRIC_COLUMNS, F.lit(None).cast("long").alias("_version"), F.lit(0).alias("_new"))
    order = F.col(version).cast("long") if version else F.lit(0).cast("long")
    newer = updates.select(*METRIC_COLUMNS, order.alias("_version"), F.lit(1).alias("_new"))
    others = [c for c in METRIC_COLUMNS if c not in METRIC_KEY]
    newest = F.max_by(F.struct(*others), F.struct("_new", "_version"))
    # The key comes out as grouping columns, so that filters on camera and time reach both scans.
    rows = older.unionByName(newer).groupBy(*METRIC_KEY).agg(newest.alias("row")).select(*METRIC_KEY, "row.*")
    return rows.select(*METRIC_COLUMNS)


def split_by_retention(df: DataFrame, column: str, as_of: Moment, age: Column) -> tuple[DataFrame, DataFrame]:
    """K1: rows to keep and rows that have outlived ``age``."""
    cutoff = moment(as_of) - age
    return df.filter(F.col(column) >= cutoff), df.filter(F.col(column) < cutoff)


def sweep(
    events: DataFrame, metrics: DataFrame, as_of: Moment, config: Retention = Retention()
) -> dict[str, DataFrame]:
    """K1: what stays of both tables, what goes, and how much of each goes."""
    hours = F.make_dt_interval(hours=F.lit(config.events_hours))
    days = F.make_dt_interval(days=F.lit(config.metrics_days))
    events_kept, events_gone = split_by_retention(events, "ts", as_of, hours)
    metrics_kept, metrics_gone = split_by_retention(metrics, "window_start", as_of, days)
    deleted = (
        events_gone.select(F.lit(1).alias("e"), F.lit(0).alias("m"))
        .unionByName(metrics_gone.select(F.lit(0).alias("e"), F.lit(1).alias("m")))
        .agg(
            F.coalesce(F.sum("e"), F.lit(0)).alias("events_deleted"),
            F.coalesce(F.sum("m"), F.lit(0)).alias("metrics_deleted"),
        )
    )
    return {
        "events_kept": events_kept,
        "metrics_kept": metrics_kept,
        "archive": archive_candidates(metrics_gone),
        "deleted": deleted,
    }


def archive_candidates(expired: DataFrame) -> DataFrame:
    """Expired metric rows with the date they are filed under."""
    return expired.select(*METRIC_COLUMNS, F.to_date("window_start").alias("date"))


def archive_metrics(expired: DataFrame, path: str) -> None:
    """Append expired rows below ``camera_id=/date=``.

    Rows of a (camera, date) go to one task where possible; the adaptive rebalance splits a group that is too big.
    Class counts are stored as JSON text.
    """
    rows = archive_candidates(expired).withColumn("counts_by_class", F.to_json("counts_by_class"))
    rows.hint("rebalance", "camera_id", "date").write.partitionBy("camera_id", "date").mode("append").parquet(path)


# --- thresholds ----------------------------------------------------------------------------------------------------


def resolve_thresholds(table: DataFrame, default: Thresholds = Thresholds()) -> Thresholds:
    """The row with the lowest id, else the defaults; a row out of order is refused. One row reaches the driver."""
    row = table.orderBy("id").select("low", "moderate", "high").first()
    return default if row is None else Thresholds(row["low"], row["moderate"], row["high"])


def reclassify(metrics: DataFrame, table: DataFrame, scoring: Scoring = Scoring()) -> DataFrame:
    """Levels of stored metrics under the thresholds in force. The row enters the plan as a scalar subquery."""
    default = scoring.thresholds
    lowest = table.agg(F.min_by(F.struct("low", "moderate", "high"), "id").alias("cuts"))
    cuts = F.coalesce(
        lowest.scalar(),
        F.struct(
            F.lit(default.low).alias("low"), F.lit(default.moderate).alias("moderate"), F.lit(default.high).alias("high")
        ),
    )
    score = congestion_score(F.col("vehicle_count"), F.col("avg_speed_kmh"), F.col("stopped_ratio"), scoring)
    level = level_between(score, cuts["low"], cuts["moderate"], cuts["high"])
    return metrics.withColumn("congestion_level", level)


# --- camera registry -----------------------------------------------------------------------------------------------


def with_aliases(cameras: DataFrame) -> DataFrame:
    """C20: accept ``lat`` and ``lng`` for the coordinates."""
    for name, alias in (("latitude", "lat"), ("longitude", "lng")):
        if alias in cameras.columns:
            given = F.coalesce(name, alias) if name in cameras.columns else F.col(alias)
            cameras = cameras.withColumn(name, given).drop(alias)
    return cameras


def camera_fault() -> Column:
    """C20: the first rule a row breaks, NULL if none. NULL fields are not judged."""
    fault = F.when(F.col("camera_id").isNull() | (F.col("camera_id") == ""), "bad_camera_id")
    fault = fault.when(F.col("name") == "", "bad_name")
    for name, longest in MAX_LENGTH.items():
        fault = fault.when(F.length(name) > longest, f"bad_{name}")
    fault = fault.when(~F.col("latitude").between(-90, 90), "bad_latitude")
    return fault.when(~F.col("longitude").between(-180, 180), "bad_longitude")


def valid_cameras(cameras: DataFrame) -> DataFrame:
    """C20: registry rows that may be created: id, name and coordinates given and within their limits."""
    rows = with_aliases(cameras)
    complete = F.col("name").isNotNull() & F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return rows.filter(complete & camera_fault().isNull())


def judge_camera_changes(registry: DataFrame, changes: DataFrame, slice_rows: int = 100_000) -> DataFrame:
    """K2: every change with ``status`` and, if applied, whether it started the camera anew (``resets``).

    A change without a camera or without a place in the order is refused, whatever it asks for. ``cleared``, if the
    table has it, lists fields that a change sets to NULL. Changes take effect in the order of ``seq``. A create needs all fields and an unused id; an update of an unknown
    camera creates it if coordinates are given; a delete needs a known camera. Whether a camera exists before a
    change is the last thing said about it, within its slice of ``seq``, in earlier slices, or by the registry.
    """
    changes = with_aliases(changes)
    nowhere = F.when(F.col("camera_id").isNull(), "rejected: bad_camera_id").when(F.col("seq").isNull(), "rejected: bad_seq")
    refused = changes.withColumns({"status": nowhere, "resets": F.lit(False)}).filter(F.col("status").isNotNull())
    changes = changes.filter(nowhere.isNull())
    located = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    create, update, delete = (F.col("action") == name for name in ("create", "update", "delete"))
    incomplete = create & (~located | F.col("name").isNull())
    unknown = F.when(~(create | update | delete) | F.col("action").isNull(), "unknown_action")
    fault = F.coalesce(unknown, F.when(~delete, camera_fault()), F.when(incomplete, "incomplete"))
    exists_after = F.when(fault.isNull(), F.when(delete, F.lit(False)).when(create | located, F.lit(True)))
    rows = changes.withColumns(
        {"_fault": fault, "_located": located, "_after": exists_after, SLICE: slice_start(F.col("seq"), slice_rows)}
    )
    order = W.partitionBy("camera_id", SLICE).orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    placed = carry(
        rows.withColumn("_said_here", F.last("_after", ignorenulls=True).over(order)),
        ["camera_id"],
        summary={"said": F.max_by("_after", F.when(F.col("_after").isNotNull(), F.col("seq")))},
        carried={"_said_before": F.last("said", ignorenulls=True).over(past(["camera_id"]))},
    )
    known = registry.select("camera_id", F.lit(True).alias("_registered"))
    exists = F.coalesce("_said_here", "_said_before", "_registered", F.lit(False))
    status = (
        F.when(F.col("_fault").isNotNull(), F.concat(F.lit("rejected: "), "_fault"))
        .when(create & F.col("_exists"), "rejected: already_exists")
        .when(delete & ~F.col("_exists"), "rejected: not_found")
        .when(update & ~F.col("_exists") & ~F.col("_located"), "rejected: not_found")
        .otherwise("applied")
    )
    judged = placed.join(known, "camera_id", "left").withColumn("_exists", exists).withColumn("status", status)
    resets = (F.col("status") == "applied") & (delete | ~F.col("_exists"))
    return judged.withColumn("resets", resets).select(*refused.columns).unionByName(refused)


def apply_camera_changes(registry: DataFrame, judged: DataFrame) -> DataFrame:
    """K2: the registry after the applied changes; fields a change leaves NULL, and doesn't clear, keep their value.

    Each field takes its newest value since the camera was last created or deleted, or else the registered one.
    """
    applied = judged.filter(F.col("status") == "applied")
    last_reset = F.max(F.when(F.col("resets"), F.col("seq")))
    cleared = F.col("cleared") if "cleared" in judged.columns else F.lit(None).cast("array<string>")
    says = lambda c: F.col(c).isNotNull() | F.coalesce(F.array_contains(cleared, c), F.lit(False))
    newest = {
        c: F.max_by(F.struct("seq", c), F.when(says(c), F.col("seq"))).alias(f"_{c}") for c in CAMERA_FIELDS
    }
    changed = applied.groupBy("camera_id").agg(
        last_reset.alias("_reset"), F.max_by("action", "seq").alias("_action"), *newest.values()
    )
    merged = registry.join(changed, "camera_id", "full_outer")
    started = F.col("_reset").isNotNull()
    fields = {}
    for c in CAMERA_FIELDS:
        valid = F.coalesce(F.col(f"_{c}.seq") >= F.coalesce("_reset", F.col(f"_{c}.seq")), F.lit(False))
        fields[c] = F.when(valid, F.col(f"_{c}.{c}")).when(~started, F.col(c))
    fields["name"] = F.coalesce(fields["name"], F.when(started, F.col("camera_id")))
    kept = F.coalesce(F.col("_action") != "delete", F.lit(True))
    return merged.filter(kept).select("camera_id", *[expr.alias(c) for c, expr in fields.items()])


def audit_rows(judged: DataFrame) -> DataFrame:
    """K5: one row per applied camera change with the fields it set and cleared; a delete has no payload."""
    applied = judged.filter(F.col("status") == "applied")
    told = [*CAMERA_FIELDS, *(c for c in ("cleared",) if c in judged.columns)]
    payload = F.when(F.col("action") != "delete", F.to_json(F.struct(*told)))
    return applied.select(
        "actor",
        F.concat(F.lit("cameras."), "action").alias("action"),
        F.lit("cameras").alias("entity_type"),
        F.col("camera_id").alias("entity_id"),
        payload.alias("payload"),
        F.col("changed_at").alias("created_at"),
    )


def ack_audit_rows(results: DataFrame) -> DataFrame:
    """K5: one row per acknowledgement that took effect."""
    applied = results.filter(F.col("status") == "acknowledged")
    return applied.select(
        F.col("admin_id").alias("actor"),
        F.lit("alerts.acknowledge").alias("action"),
        F.lit("alerts").alias("entity_type"),
        F.col("alert_id").alias("entity_id"),
        F.to_json(F.struct("admin_id")).alias("payload"),
        F.col("acknowledged_at").alias("created_at"),
    )
