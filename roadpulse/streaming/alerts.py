"""The alert state machine on a stream of metric rows, one open alert per camera as keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from roadpulse.config import LATENESS_SECONDS, WINDOW_SECONDS, Scoring
from roadpulse.functions.rules import severity_of
from roadpulse.operators.alerts import describe, unresolved, with_alert_segment
from roadpulse.operators.projections import camera_wide
from roadpulse.streaming.metrics import stream_metrics

# Times are whole microseconds in state and on the way to it, so that no zone can move them.
CHANGES = (
    "camera_id string, change string, _at bigint, triggered_at bigint, resolved_at bigint, "
    "_severity string, congestion_level string, congestion_score double, _known_id string"
)
NAMES = [field.split()[0] for field in CHANGES.split(", ")]
SHOWN = "severity string, level string, score double"


# Workers get the processor with its code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class AlertState(StatefulProcessor):
    """The machine takes the windows of a camera in the order of their start, each once the watermark has reached it.

    State is the open alert (opening time, the severity, level and score it shows, and its id if an existing table
    gave it one) and the windows that wait for the watermark. A batch adds its windows in one call and sets one timer,
    for its earliest; whatever expires takes all windows that are due and sets the next. A window that comes after
    the watermark has passed its start is late and dropped, as everywhere.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", f"triggered_at bigint, {SHOWN}, known_id string")
        self._waiting = handle.getListState("waiting", f"start bigint, end bigint, {SHOWN}")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        columns = [initialState[c].tolist() for c in ("triggered_at", "severity", "congestion_level", "congestion_score", "alert_id")]
        self._open.update(max(zip(*columns, strict=True), key=lambda row: row[0]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        arrived = []
        for pdf in rows:
            columns = [pdf[c].tolist() for c in ("start", "end", "severity", "congestion_level", "congestion_score")]
            arrived += [(s, e, v if isinstance(v, str) else None, level, score) for s, e, v, level, score in zip(*columns, strict=True)]
        if arrived:
            self._waiting.appendList(arrived)
            self._handle.registerTimer(min(w[0] for w in arrived) // 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        waiting = sorted((tuple(w) for w in self._waiting.get()), key=lambda w: w[0]) if self._waiting.exists() else []
        due = [w for w in waiting if w[0] <= passed]
        if not due:
            return
        opened = tuple(self._open.get()) if self._open.exists() else None
        changes = []
        for _, end, severity, level, score in due:
            if severity is not None:
                change = "updated" if opened else "opened"
                opened = (opened[0] if opened else end, severity, level, score, opened[4] if opened else None)
                changes.append((key[0], change, end, opened[0], None, *opened[1:]))
            elif opened:
                changes.append((key[0], "resolved", end, opened[0], end, *opened[1:]))
                opened = None
        if opened:
            self._open.update(opened)
        elif self._open.exists():
            self._open.clear()
        later = waiting[len(due) :]
        if later:
            self._waiting.put(later)
            self._handle.registerTimer(later[0][0] // 1000)
        else:
            self._waiting.clear()
        if changes:
            out = pd.DataFrame(changes, columns=NAMES)
            yield out.astype({"_at": "int64", "triggered_at": "int64", "resolved_at": "Int64"})


def stream_alerts(metrics: DataFrame, registry: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Every opening, update and resolution as an alert row with ``change`` and ``changed_at``.

    ``metrics`` needs a watermark: that of ``read_metrics_stream``, or of the detections it is aggregated from. What
    the batch operator would say of the windows up to the watermark is said, in their order, whatever batch they
    come in. ``existing`` is an alerts table to go on from: with a new checkpoint, the newest open alert of each of its
    cameras is updated or resolved under its own id; ``metrics`` then holds the windows after those of the table.
    """
    micros = lambda c: F.unix_micros(F.col(c))
    rows = camera_wide(metrics).select(
        "camera_id",
        micros("window_start").alias("start"),
        micros("window_end").alias("end"),
        severity_of(F.col("congestion_level")).alias("severity"),
        "congestion_level",
        "congestion_score",
    )
    held = None
    if existing is not None:
        held = unresolved(existing).select(
            "camera_id", micros("triggered_at").alias("triggered_at"), "severity", "congestion_level", "congestion_score", "alert_id"
        ).groupBy("camera_id")
    changes = rows.groupBy("camera_id").transformWithStateInPandas(
        AlertState(), outputStructType=CHANGES, outputMode="append", timeMode="eventTime", initialState=held
    )
    timed = changes.withColumns({c: F.timestamp_micros(F.col(c)) for c in ("_at", "triggered_at", "resolved_at")})
    described = describe(
        with_alert_segment(timed, registry), F.col("change"), F.col("_at").alias("changed_at"), F.col("_known_id")
    )
    return described.withColumn("alert_id", F.coalesce("_known_id", "alert_id")).drop("_known_id")


def detections_to_alerts(
    events: DataFrame,
    registry: DataFrame,
    seconds: int = WINDOW_SECONDS,
    lateness_seconds: int = LATENESS_SECONDS,
    scoring: Scoring = Scoring(),
    existing: DataFrame | None = None,
) -> DataFrame:
    """Windows and alerts chained in one query, with no table in between."""
    return stream_alerts(stream_metrics(events, seconds, lateness_seconds, scoring), registry, existing)


def current_alerts(changes: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The alerts table behind a log of changes: the newest change of each alert.

    Alerts of an ``existing`` table are older than any change; their acknowledgements stay theirs.
    """
    columns = [c for c in changes.columns if c not in ("change", "changed_at", "alert_id")]
    if existing is not None:
        held = existing.select("alert_id", *columns, F.lit(None).cast("timestamp").alias("changed_at"), F.lit(0).alias("_log"))
        changes = changes.select("alert_id", *columns, "changed_at", F.lit(1).alias("_log")).unionByName(held)
        newest = F.max_by(F.struct(*columns), F.struct("_log", "changed_at")).alias("row")
        acked = F.struct("acknowledged_at", "acknowledged_by")
        first = F.min(F.when(F.col("acknowledged_at").isNotNull(), acked)).alias("_ack")
        merged = changes.groupBy("alert_id").agg(newest, first).select("alert_id", "row.*", "_ack")
        return merged.withColumns({c: F.col(f"_ack.{c}") for c in ("acknowledged_at", "acknowledged_by")}).drop("_ack")
    newest = F.max_by(F.struct(*columns), "changed_at").alias("row")
    return changes.groupBy("alert_id").agg(newest).select("alert_id", "row.*")
