"""Hand-made rows."""

from __future__ import annotations

import json
from datetime import datetime, timedelta, timezone

from roadpulse.schemas import ACK, CAMERA, METRIC, RAW_EVENT

T0 = datetime(2026, 4, 16, 10, 0, 0, tzinfo=timezone.utc)

DETECTION = {
    "camera_id": "bridge-north", "timestamp": "2025-11-03T06:41:07.250Z", "frame_id": 7311, "vehicle_id": "track-58",
    "class": "car", "confidence": 0.61, "bbox": {"x": 33, "y": 640, "w": 120, "h": 75}, "centroid": {"x": 93, "y": 677},
}


def at(seconds: float) -> datetime:
    return T0 + timedelta(seconds=seconds)


def message(drop: str | None = None, **changes) -> str:
    return json.dumps({k: v for k, v in (DETECTION | changes).items() if k != drop})


def messages(spark, texts):
    return spark.createDataFrame([(t,) for t in texts], "value STRING")


def event(second, vehicle="v1", camera="cam_01", speed=None, lane=None, kind="car", x=0.0, y=0.0, frame=0):
    return dict(
        camera_id=camera, ts=at(second), vehicle_id=vehicle, vehicle_class=kind, centroid_x=x, centroid_y=y,
        speed_kmh=speed, frame_id=frame, confidence=0.9, bbox_x=0, bbox_y=0, bbox_w=1, bbox_h=1, lane_id=lane,
    )


def _frame(spark, rows, schema):
    return spark.createDataFrame([tuple(row.get(f.name) for f in schema) for row in rows], schema)


def events(spark, rows):
    return _frame(spark, rows, RAW_EVENT)


def metric(camera="cam_01", n=0, level="LOW", score=None, lane=None, count=10, speed=20.0, queue=0, step=5, **more):
    row = dict(
        camera_id=camera, window_start=at(n * step), window_end=at((n + 1) * step), lane_id=lane, vehicle_count=count,
        counts_by_class={"car": count}, avg_speed_kmh=speed, stopped_ratio=0.1, queue_length=queue,
        congestion_level=level,
        congestion_score={"LOW": 0.1, "MODERATE": 0.4, "HIGH": 0.7, "SEVERE": 0.9}[level] if score is None else score,
    )
    return row | more


def metrics(spark, rows):
    return _frame(spark, rows, METRIC)


def cameras(spark, *rows):
    named = [dict(zip(("camera_id", "latitude", "longitude", "road_segment"), r)) for r in rows]
    return _frame(spark, [{"name": r["camera_id"]} | r for r in named], CAMERA)


def acks(spark, *rows):
    return spark.createDataFrame(list(rows), ACK)


def one(df):
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0]
