import random
from math import hypot

from pyspark.sql import functions as F

from roadpulse.config import Scoring, SpeedFallback, Thresholds
from roadpulse.functions.rules import congestion_score, level_of, normalize
from roadpulse.operators.speed import fill_speed
from roadpulse.operators.windows import window_metrics
from tests.data import at, event, events, one


def _value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_c7_normalize(spark):
    cases = [(0, 100, 0.0), (50, 100, 0.5), (150, 100, 1.0), (-10, 100, 0.0), (50, 0, 0.0)]
    for value, maximum, want in cases:
        assert _value(spark, normalize(F.lit(value), maximum)) == want


def test_c8_levels(spark):
    def level(count, speed, stopped, scoring=Scoring()):
        score = congestion_score(F.lit(count), F.lit(speed), F.lit(stopped), scoring)
        return _value(spark, level_of(score, scoring.thresholds)), _value(spark, score)

    name, score = level(5, 55.0, 0.0)
    assert name == "LOW" and score < 0.30
    name, score = level(45, 5.0, 0.8)
    assert name in ("HIGH", "SEVERE") and score > 0.55
    assert level(20, 30.0, 0.2)[0] in ("LOW", "MODERATE")
    assert level(20, 30.0, 0.2, Scoring(thresholds=Thresholds(0.1, 0.2, 0.3)))[0] in ("HIGH", "SEVERE")


def test_c9_score_on_a_threshold_belongs_above(spark):
    assert [_value(spark, level_of(F.lit(s))) for s in (0.3, 0.55, 0.8)] == ["MODERATE", "HIGH", "SEVERE"]


def test_e1_one_event(spark):
    row = one(window_metrics(events(spark, [event(1, speed=30.0)])))
    assert (row.vehicle_count, row.avg_speed_kmh, row.stopped_ratio, row.queue_length) == (1, 30.0, 0.0, 0)
    assert (row.lane_id, (row.window_end - row.window_start).total_seconds()) == (None, 5.0)


def test_e1_stopped_and_queue(spark):
    rows = [event(0, "v1", speed=2.0), event(1, "v2", speed=3.0), event(2, "v3", speed=40.0), event(3, "v1", speed=1.0)]
    row = one(window_metrics(events(spark, rows)))
    assert (row.vehicle_count, row.queue_length, row.stopped_ratio) == (3, 2, 0.75)


def test_e3_counts_are_of_events(spark):
    rows = [event(0, "a"), event(1, "b", kind="truck"), event(2, "a")]
    row = one(window_metrics(events(spark, rows)))
    assert row.counts_by_class == {"car": 2, "truck": 1}
    assert (row.vehicle_count, row.avg_speed_kmh, row.stopped_ratio) == (2, 0.0, 0.0)


def test_e1_two_grains_against_plain_python(spark):
    rng = random.Random(5)
    rows = [
        event(
            rng.randrange(60), f"v{rng.randrange(8)}", f"cam_{rng.choice('0001')}", rng.choice([None, 2.0, 30.5]),
            rng.choice([None, 1, 2]), rng.choice(["car", "bus"]),
        )
        for _ in range(400)
    ]
    groups = {}
    for r in rows:
        start = (r["ts"] - at(0)).seconds // 5
        for lane in {None, r["lane_id"]}:
            groups.setdefault((r["camera_id"], start, lane), []).append(r)
    want = {}
    for key, members in groups.items():
        speeds = [m["speed_kmh"] for m in members if m["speed_kmh"] is not None]
        stopped = {m["vehicle_id"] for m in members if m["speed_kmh"] is not None and m["speed_kmh"] < 5}
        mean = sum(speeds) / len(speeds) if speeds else 0.0
        want[key] = (len({m["vehicle_id"] for m in members}), len(stopped), round(mean, 2))
    got = {
        (r.camera_id, int(r.window_start.timestamp() - at(0).timestamp()) // 5, r.lane_id):
            (r.vehicle_count, r.queue_length, r.avg_speed_kmh)
        for r in window_metrics(events(spark, rows)).collect()
    }
    assert got.keys() == want.keys()
    for key in want:
        assert got[key][:2] == want[key][:2] and abs(got[key][2] - want[key][2]) <= 0.0101


def _speeds(spark, rows, calibration=None, ttl=30, **options):
    filled = fill_speed(events(spark, rows), calibration, SpeedFallback(ttl_seconds=ttl), **options)
    return {r.frame_id: r.speed_kmh for r in filled.collect()}


def test_f1_calibrated_and_default_scale(spark):
    for camera, want in (("cam_01", 3.6), ("cam_02", 1.8)):
        rows = [event(0, camera=camera, frame=1), event(1, camera=camera, frame=2, x=10.0)]
        for calibration in ({"cam_01": 0.10}, spark.createDataFrame([("cam_01", 0.10)], "camera_id STRING, meters_per_pixel DOUBLE")):
            speeds = _speeds(spark, rows, calibration)
            assert speeds[1] is None and abs(speeds[2] - want) < 1e-9


def test_f1_f2_limits(spark):
    rows = [
        event(0, frame=1), event(0, frame=2, x=5.0),  # no time between
        event(30, frame=3, x=10.0),  # exactly the TTL
        event(61, frame=4, x=20.0),  # 31 s later: forgotten
        event(62, frame=5, x=20.0, speed=50.0), event(63, frame=6, x=30.0),  # a given speed stays, its place counts
    ]
    speeds = _speeds(spark, rows)
    assert speeds[1] is None and speeds[2] is None and speeds[4] is None
    assert abs(speeds[3] - 5 * 0.05 / 30 * 3.6) < 1e-9
    assert speeds[5] == 50.0 and abs(speeds[6] - 10 * 0.05 * 3.6) < 1e-9


def test_f1_slices_change_nothing(spark):
    rng = random.Random(3)
    rows = [
        event(rng.uniform(0, 2000), rng.choice("aab"), x=rng.uniform(0, 99), y=rng.uniform(0, 99), frame=i)
        for i in range(500)
    ]
    last, want = {}, {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["frame_id"])):
        p = last.get(r["vehicle_id"])
        dt = (r["ts"] - p["ts"]).total_seconds() if p else 0
        d = hypot(r["centroid_x"] - p["centroid_x"], r["centroid_y"] - p["centroid_y"]) if p else 0
        want[r["frame_id"]] = d * 0.05 / dt * 3.6 if 0 < dt <= 30 else None
        last[r["vehicle_id"]] = r
    for slices in (1, 2, 20):
        got = _speeds(spark, rows, slices_per_ttl=slices)
        assert len(got) == len(want)
        for frame, speed in want.items():
            assert (got[frame] is None) == (speed is None)
            assert speed is None or abs(got[frame] - speed) < 1e-6
