"""Speed fallback on a stream, with the last positions of a bucket of vehicles in a slice of time as keyed state."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from roadpulse.config import LATENESS_SECONDS, SpeedFallback
from roadpulse.operators.speed import with_scale
from roadpulse.plans.slices import COPY, MICROS, SLICE, overlap


# Workers get the processor with its code, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class SpeedState(StatefulProcessor):
    """The last sightings of a bucket of vehicles within a slice of time, which begins with copies of those just before it.

    A batch costs a bucket one read and one write of state, however many vehicles it has. Rows of one batch arrive in any
    order and are sorted by vehicle and time first; copies only serve as sightings. Times are whole microseconds in state
    and on the way to it, so that no zone can move them.
    """

    def __init__(self, ttl_seconds: int) -> None:
        self._ttl = ttl_seconds * MICROS

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getListState("last", "vehicle_id string, x double, y double, at bigint")

    def _held(self) -> pd.DataFrame:
        rows = [tuple(row) for row in self._last.get()] if self._last.exists() else []
        return pd.DataFrame(rows, columns=["vehicle_id", "x", "y", "at"]).astype({"x": float, "y": float, "at": "int64"})

    def _hold(self, last: pd.DataFrame) -> None:
        columns = [last[c].tolist() for c in ("vehicle_id", "x", "y", "at")]
        if len(last):
            self._last.put([(v if isinstance(v, str) else None, x, y, at) for v, x, y, at in zip(*columns, strict=True)])
        else:
            self._last.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen, held = pd.concat(list(rows), ignore_index=True), self._held()
        codes, _ = pd.factorize(pd.concat([held["vehicle_id"], seen["vehicle_id"]]), use_na_sentinel=False)
        held.index, seen["_code"] = codes[: len(held)], codes[len(held) :]
        seen = seen.sort_values(["_code", "at_micros", "frame_id"], ignore_index=True)
        x, y, at = seen["centroid_x"].shift(), seen["centroid_y"].shift(), seen["at_micros"].shift()
        first = ~seen["_code"].duplicated()
        before = held.reindex(seen.loc[first, "_code"])  # NaN for a vehicle that is not held
        for column, name in ((x, "x"), (y, "y"), (at, "at")):
            column[first] = before[name].to_numpy()
        elapsed = seen["at_micros"] - at
        metres = np.hypot(seen["centroid_x"] - x, seen["centroid_y"] - y) * seen["meters_per_pixel"]
        speed = (metres / (elapsed / MICROS) * 3.6).where((elapsed > 0) & (elapsed <= self._ttl))
        seen["speed_kmh"] = seen["speed_kmh"].fillna(speed)
        newest = seen[~seen["_code"].duplicated(keep="last")].set_index("_code")
        newest = newest.rename(columns={"centroid_x": "x", "centroid_y": "y", "at_micros": "at"})[list(held.columns)]
        # Of equal times the later batch's sighting stays.
        both = pd.concat([held, newest.dropna(subset="at")]).sort_values("at", kind="stable")
        both = both[~both.index.duplicated(keep="last")].astype({"at": "int64"})
        self._hold(both[both["at"] + self._ttl >= timerValues.getCurrentWatermarkInMs() * 1000])
        if len(both):
            self._handle.registerTimer((int(both["at"].max()) + self._ttl) // 1000 + 1)
        yield seen.loc[~seen["is_copy"]].drop(columns=["_code", "meters_per_pixel", "is_copy", "slice_start", "bucket"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self._held()
        self._hold(held[held["at"] + self._ttl >= expiredTimerInfo.getExpiryTimeInMs() * 1000])
        return iter(())


def stream_fill_speed(
    events: DataFrame,
    calibration: DataFrame | dict[str, float] | None = None,
    config: SpeedFallback = SpeedFallback(),
    lateness_seconds: int = LATENESS_SECONDS,
    slices_per_ttl: int = 20,
    buckets: int = 64,
) -> DataFrame:
    """``fill_speed`` for a stream of raw events. State is dropped once the watermark passes its TTL.

    State is kept per slice of many TTLs and bucket of vehicles (by the hash of their id); sightings of the last TTL of a
    slice are copied into the next one, which needs no others. So a vehicle id that owns a third of a backlog spreads over
    as many tasks as it has slices, and what a batch costs follows its rows, not the number of its vehicles. A task holds
    the rows that one bucket of a slice has in a batch. A sighting that comes in a later batch than a newer one doesn't
    replace it.
    """
    columns, ttl = events.columns, config.ttl_seconds * MICROS
    scaled, px_to_m = with_scale(events, calibration, config.pixel_to_meter)
    scaled = scaled.select(*columns, px_to_m.alias("meters_per_pixel")).withWatermark("ts", f"{lateness_seconds} seconds")
    placed = overlap(scaled, F.unix_micros("ts"), ttl * slices_per_ttl, before=ttl)
    # Workers get the columns by name, but for names that begin with an underscore.
    rows = placed.withColumnsRenamed({SLICE: "slice_start", COPY: "is_copy"}).withColumn("at_micros", F.unix_micros("ts")).drop("ts")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("vehicle_id"), F.lit(buckets)))
    fields = [T.StructField(f.name, f.dataType) for f in events.schema if f.name != "ts"]
    filled = rows.groupBy("bucket", "slice_start").transformWithStateInPandas(
        SpeedState(config.ttl_seconds),
        outputStructType=T.StructType([*fields, T.StructField("at_micros", T.LongType())]),
        outputMode="append",
        timeMode="eventTime",
    )
    return filled.withColumn("ts", F.timestamp_micros("at_micros")).select(*columns)
