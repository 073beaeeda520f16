"""Every table's schema, declared once."""

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in fields.items()])


_s, _i, _l, _d, _ts = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.TimestampType(),
)

BBOX = _struct(x=_d, y=_d, w=_d, h=_d)
CENTROID = _struct(x=_d, y=_d)

DETECTION = T.StructType(
    [
        T.StructField("camera_id", _s, False),
        T.StructField("timestamp", _ts, False),
        T.StructField("frame_id", _l, False),
        T.StructField("vehicle_id", _s, False),
        T.StructField("class", _s, False),
        T.StructField("confidence", _d, False),
        T.StructField("bbox", BBOX, False),
        T.StructField("centroid", CENTROID, False),
        T.StructField("lane_id", _i, True),
        T.StructField("speed_estimate", _d, True),
    ]
)

RAW_EVENT = _struct(
    camera_id=_s, ts=_ts, vehicle_id=_s, vehicle_class=_s, centroid_x=_d, centroid_y=_d, speed_kmh=_d,
    frame_id=_l, confidence=_d, bbox_x=_i, bbox_y=_i, bbox_w=_i, bbox_h=_i, lane_id=_i,
)

METRIC = _struct(
    camera_id=_s, window_start=_ts, window_end=_ts, lane_id=_i, vehicle_count=_l,
    counts_by_class=T.MapType(_s, _l), avg_speed_kmh=_d, stopped_ratio=_d, queue_length=_l,
    congestion_level=_s, congestion_score=_d,
)

CAMERA = _struct(
    camera_id=_s, name=_s, latitude=_d, longitude=_d, road_segment=_s, description=_s,
)

ALERT = _struct(
    alert_id=_s, camera_id=_s, road_segment=_s, alert_type=_s, severity=_s, title=_s, message=_s,
    congestion_level=_s, congestion_score=_d, triggered_at=_ts, resolved_at=_ts,
    acknowledged_by=_s, acknowledged_at=_ts, payload=_s,
)

ACK = _struct(ack_id=_l, alert_id=_s, admin_id=_s, acknowledged_at=_ts)

THRESHOLD_ROW = _struct(id=_l, low=_d, moderate=_d, high=_d)

CAMERA_CHANGE = _struct(
    seq=_l, actor=_s, action=_s, camera_id=_s, name=_s, latitude=_d, longitude=_d, road_segment=_s,
    description=_s, changed_at=_ts,
)

LANE = _struct(camera_id=_s, camera_pos=_l, lane_id=_i, lane_pos=_l)
CROSS_EDGE = _struct(from_camera=_s, from_lane=_i, to_camera=_s, to_lane=_i)

SENSOR_READING = _struct(t=_ts, sensor_id=_l, flow=_d, occupancy=_d, speed=_d)
SENSOR_MAP = _struct(sensor_id=_l, camera_id=_s, lane_id=_i)
SENSOR_EDGE = T.StructType([T.StructField("from", _l), T.StructField("to", _l), T.StructField("cost", _d)])

FORECAST = _struct(
    camera_id=_s, lane_id=_i, origin=_ts, step=_i, predicted_at=_ts, vehicle_count=_d, congestion_prob=_d,
    congestion_level=_s,
)
