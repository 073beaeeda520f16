import pytest

from roadpulse.operators import analytics as an
from roadpulse.operators import dashboard as db
from roadpulse.operators import latest as lt
from roadpulse.operators import projections as pj
from roadpulse.operators.alerts import alerts_from_metrics
from tests.data import at, cameras, event, events, metric, metrics, one


def _two(spark):
    return metrics(
        spark,
        [
            metric("a", 0, "LOW", count=99), metric("a", 1, "MODERATE", count=10, speed=20.0),
            metric("b", 1, "SEVERE", count=30, speed=5.0), metric("b", 2, "LOW", lane=1),
        ],
    )


def test_e14_summary(spark):
    rows = _two(spark).filter("window_start >= '2026-04-16 10:00:05'")
    alerts = alerts_from_metrics(rows, cameras(spark))
    row = one(db.dashboard_summary(rows, alerts, at(60)))
    assert (row.total_cameras_active, row.total_vehicles_last_window, row.average_speed_kmh_5m) == (2, 40, 12.5)
    assert row.congestion_breakdown == {"LOW": 0, "MODERATE": 1, "HIGH": 0, "SEVERE": 1}
    assert row.worst_camera.camera_id == "b" and (row.active_alerts, row.total_incidents_24h) == (1, 1)


def test_e14_empty(spark):
    rows = metrics(spark, [])
    row = one(db.dashboard_summary(rows, alerts_from_metrics(rows, cameras(spark)), at(0)))
    assert (row.total_cameras_active, row.active_alerts, row.average_speed_kmh, row.worst_camera) == (0, 0, 0.0, None)
    assert db.worst_camera(rows).count() == 0


def test_d1_d2_d3(spark):
    rows = _two(spark)
    assert {r.camera_id: r.vehicle_count for r in lt.latest_per_camera(rows).collect()} == {"a": 10, "b": 30}
    assert one(lt.latest_per_camera(rows, "a")).vehicle_count == 10
    assert one(lt.latest_per_lane(rows)).lane_id == 1
    assert one(lt.current_metrics(rows, "b")).congestion_level == "SEVERE"
    empty = one(lt.current_metrics(rows, "zzz"))
    assert (empty.camera_id, empty.vehicle_count, empty.counts_by_class, empty.congestion_level) == ("zzz", 0, {}, "LOW")
    assert {r.camera_id for r in lt.list_cameras(rows).collect()} == {"a", "b"}


def test_g1_g2(spark):
    rows = events(spark, [event(i, frame=i) for i in range(15)])
    newest = lt.recent_events(rows, 5).collect()
    assert [r.timestamp for r in newest] == sorted((r.timestamp for r in newest), reverse=True) and len(newest) == 5
    for n in (0, 101):
        with pytest.raises(ValueError):
            lt.recent_events(rows, n)
    history = lt.metrics_history(_two(spark), "a", at(0), at(5)).collect()
    assert [r.vehicle_count for r in history] == [99, 10]


def test_e17_e18_need_a_place(spark):
    rows = metrics(spark, [metric("a", count=20), metric("b", count=10, level="SEVERE"), metric("c", level="SEVERE")])
    registry = cameras(spark, ("a", 1.0, 2.0, "A"), ("b", 3.0, 4.0, None), ("c", None, 4.0, "C"))
    heat = {r.camera_id: r.weight for r in db.heatmap(rows, registry, at(10)).collect()}
    assert heat == {"a": 1.0, "b": 0.5}
    assert one(db.incidents(rows, registry)).camera_id == "b"
    assert one(db.incidents(rows, registry, "LOW")).camera_id == "a"
    with pytest.raises(ValueError):
        db.incidents(rows, registry, "WILD")
    assert db.heat_snapshot(rows, at(10)).count() == 3
    assert db.heat_snapshot(rows, at(400)).count() == 0


def test_e18_no_vehicles(spark):
    registry = cameras(spark, ("a", 1.0, 2.0, "A"))
    assert one(db.heatmap(metrics(spark, [metric("a", count=0)]), registry, at(10))).weight == 0.0


def test_e8_e13(spark):
    rows = metrics(
        spark,
        [metric("a", n, level, step=3600) for n, level in enumerate(["LOW", "HIGH", "SEVERE", "LOW"])]
        + [metric("a", 1, "SEVERE", lane=1, step=3600)],
    )
    row = one(an.range_summary(rows, at(0), at(7200)))
    assert (row.vehicle_count, row.incident_count, row.peak_hour) == (30, 2, 12)
    assert abs(row.average_congestion - (0.1 + 0.7 + 0.9) / 3) < 1e-9
    empty = one(an.range_summary(rows, at(90_000), at(99_000)))
    assert (empty.vehicle_count, empty.average_congestion, empty.peak_hour) == (0, 0.0, None)
    both = one(an.compare_ranges(rows, (at(0), at(3600)), (at(3600), at(10_800))))
    assert (both.a_incident_count, both.b_incident_count, both.incident_delta, both.vehicle_count_delta) == (1, 2, 1, 10)
    assert both.a_peak_hour == 11 and both.b_peak_hour == 12
    found = one(an.incident_summary(rows, None, at(0), as_of=at(14_400)))
    assert (found.total_incidents, found.high, found.critical) == (2, 1, 1)
    assert [r.hour for r in an.hourly_trends(rows, at(0), at(14_400)).collect()] == [10, 11, 12, 13]
    with pytest.raises(ValueError):
        an.range_summary(rows, None, None)


def test_e9_ties_go_to_the_earliest_hour(spark):
    rows = metrics(spark, [metric("a", n, "HIGH", step=3600) for n in range(3)])
    assert one(an.peak_hour(rows, at(0), at(9999))).peak_hour == 10


def test_e12_segments(spark):
    registry = cameras(spark, ("a", 1.0, 2.0, "S"), ("b", 1.0, 2.0, "S"), ("c", 1.0, 2.0, None))
    rows = metrics(
        spark,
        [metric("a", 0, "SEVERE", queue=4), metric("b", 0, "LOW"), metric("c", 0, "HIGH"), metric("d", 0, "SEVERE")],
    )
    top = an.top_segments(rows, registry, at(0), at(100)).collect()
    assert [r.segment_key for r in top] == ["d", "c", "S"]
    assert (top[2].severe_minutes, top[2].average_queue_length, top[2].incident_count) == (5, 2.0, 1)
    assert len(an.top_segments(rows, registry, at(0), at(100), k=1).collect()) == 1


def test_c4_bounds(spark):
    rows = metrics(spark, [metric("a", n) for n in range(4)])
    assert pj.in_range(rows, at(5), at(10)).count() == 2
    assert pj.in_range(rows, at(5), at(10), closed=False).count() == 1
    assert lt.scan_lane_metrics(metrics(spark, [metric(lane=1), metric()]), at(0), at(5)).count() == 1
