from pyspark.sql import functions as F

from roadpulse.config import VEHICLE_CLASSES
from roadpulse.operators.projections import flatten_event
from roadpulse.sources.detections import parse_detections, reject_reasons, type_detections
from tests.data import message, messages

ACCEPTED = [
    message(),
    *[message(**{"class": c}) for c in VEHICLE_CLASSES],
    message(bbox={"x": 1.5, "y": 2.25, "w": 3.9, "h": 4}, centroid={"x": 0.5, "y": 1.25}),
    message(latitude=1.0, longitude=2.0),
    message(frame_id="7"),
    message(frame_id=7.0),
    message(frame_id=9007199254740993),
    message(frame_id=True),
    message(lane_id=None, speed_estimate=None),
    message(lane_id="3", speed_estimate="12.5"),
    message(drop="class", vehicle_class="bus"),
    message(timestamp=1700000000),
    message(timestamp="2025-11-03T12:11:07.250+05:30"),
    message(vehicle_id="7"),
    message(confidence=0),
    message(confidence=1),
]
REFUSED = {
    "not json": "malformed_json",
    "": "malformed_json",
    message() + " x": "malformed_json",
    message() + "}": "malformed_json",
    message() + "," + message(): "malformed_json",
    "[1]": "not_an_object",
    "null": "not_an_object",
    '{"camera_id": "c"}': "bad_timestamp",
    message(camera_id=5): "bad_camera_id",
    message(vehicle_id=True): "bad_vehicle_id",
    message(timestamp="bad", frame_id="NaN"): "bad_timestamp",
    message(timestamp="2026-13-45T00:00:00Z"): "bad_timestamp",
    message(frame_id="NaN"): "bad_frame_id",
    message(frame_id=1.5): "bad_frame_id",
    message(drop="class"): "bad_class",
    message(bbox=5): "bad_bbox",
    message(centroid={"x": 1}): "bad_centroid",
    message(lane_id="x"): "bad_lane_id",
    message(lane_id="true"): "bad_lane_id",
    message(speed_estimate={"a": 1}): "bad_speed_estimate",
    message(confidence=1.5): "confidence_out_of_range",
    message(confidence=-0.1): "confidence_out_of_range",
    message(**{"class": "spaceship"}): "unknown_class",
}


def test_a2_accepts(spark):
    typed = type_detections(messages(spark, ACCEPTED))
    assert [r for r in typed.collect() if r.reject_reason] == []


def test_a2_values(spark):
    valid, _ = parse_detections(messages(spark, ACCEPTED))
    frames = {r.frame_id for r in valid.collect()}
    assert {7311, 7, 1, 9007199254740993} == frames
    moments = {r[0] for r in valid.select(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSS")).collect()}
    assert moments == {"2025-11-03 06:41:07.250", "2023-11-14 22:13:20.000"}
    assert valid.filter("bbox.x = 1.5 and bbox.w = 3.9 and centroid.y = 1.25").count() == 1
    assert valid.filter("lane_id = 3 and speed_estimate = 12.5").count() == 1


def test_a2_refuses_with_reason(spark):
    typed = type_detections(messages(spark, list(REFUSED)))
    assert {r.value: r.reject_reason for r in typed.collect()} == REFUSED


def test_j4_counts(spark):
    valid, rejected = parse_detections(messages(spark, ACCEPTED + list(REFUSED)))
    counts = {r.reject_reason: r.records for r in reject_reasons(rejected).collect()}
    assert sum(counts.values()) == len(REFUSED) and counts["malformed_json"] == 5
    assert valid.count() == len(ACCEPTED)


def test_c1_flatten_truncates_boxes(spark):
    valid, _ = parse_detections(messages(spark, [message(bbox={"x": 3.9, "y": -3.9, "w": 1, "h": 2.5}, lane_id=2)]))
    row = flatten_event(valid).first()
    assert (row.bbox_x, row.bbox_y, row.bbox_w, row.bbox_h, row.lane_id) == (3, -3, 1, 2, 2)
    assert (row.centroid_x, row.vehicle_class, row.speed_kmh) == (93.0, "car", None)


def test_a1_reads_a_folder_of_texts(spark, tmp_path):
    from roadpulse.sources.detections import read_detections
    from roadpulse.streaming.stats import observe_detections, stream_stats

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join([message(), "junk", message(confidence=3)]))
    typed = observe_detections(type_detections(read_detections(spark, str(tmp_path / "in"))))
    query = typed.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c"))
    query = query.trigger(availableNow=True).start()
    query.awaitTermination()
    stats = [r for r in stream_stats(query).collect() if r.input_rows]
    assert stats[0].input_rows == 3
    assert '"accepted": 1' in stats[0].observed and '"rejected": 2' in stats[0].observed


def test_parsing_runs_compiled(spark):
    """No stage of the parsing may have methods that the JVM leaves interpreted: those beyond its limit go without whole-stage code."""
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000
