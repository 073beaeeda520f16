"""Typed envelopes for subscribers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadpulse.config import EVENT_TYPES
from roadpulse.operators.projections import Moment, moment


def to_envelope(df: DataFrame, event_type: str, ts: Moment | None = None) -> DataFrame:
    """Each row as ``(event, ts, data)`` with ``data`` as JSON; an unknown type is an error before anything runs."""
    if event_type not in EVENT_TYPES:
        raise ValueError(f"unknown event type {event_type!r}")
    return df.select(
        F.lit(event_type).alias("event"),
        (F.current_timestamp() if ts is None else moment(ts)).alias("ts"),
        F.to_json(F.struct("*")).alias("data"),
    )


def select_events(envelopes: DataFrame, types: str | None = None, camera_id: str | None = None) -> DataFrame:
    """Envelopes of the wanted types (comma list, all if empty), optionally of one camera only."""
    wanted = [name.strip() for name in (types or "").split(",") if name.strip()]
    if wanted:
        envelopes = envelopes.filter(F.col("event").isin(*wanted))
    if camera_id is not None:
        envelopes = envelopes.filter(F.get_json_object("data", "$.camera_id") == camera_id)
    return envelopes
