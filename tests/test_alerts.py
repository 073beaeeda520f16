import csv
import glob
import random

from roadpulse.operators import alerts as al
from tests.data import acks, at, cameras, metric, metrics, one


def _sequence(spark, levels, registry=None, slice_seconds=86_400, **more):
    rows = metrics(spark, [metric(n=i, level=level, **more) for i, level in enumerate(levels)])
    registry = cameras(spark) if registry is None else registry
    return sorted(al.alerts_from_metrics(rows, registry, slice_seconds).collect(), key=lambda r: r.triggered_at)


def _naive(moment):
    return moment.replace(tzinfo=None)


def test_j5_opens_updates_resolves(spark):
    (alert,) = _sequence(spark, ["LOW", "HIGH", "SEVERE", "LOW"])
    assert (alert.severity, alert.congestion_level, alert.title) == ("CRITICAL", "SEVERE", "CRITICAL congestion")
    assert _naive(alert.triggered_at).second == 10 and _naive(alert.resolved_at).second == 20
    assert alert.message == "Congestion resolved for camera cam_01" and alert.alert_type == "CONGESTION"


def test_j5_reopens(spark):
    first, second = _sequence(spark, ["HIGH", "LOW", "HIGH"])
    assert first.resolved_at is not None and second.resolved_at is None
    assert second.message == "WARNING congestion detected at camera cam_01"


def test_j5_nothing_to_report(spark):
    assert _sequence(spark, ["MODERATE", "LOW"]) == []
    assert _sequence(spark, ["SEVERE", "SEVERE"], lane=1) == []


def test_d7_segment(spark):
    registry = cameras(spark, ("cam_01", 1.0, 2.0, "A1"), ("cam_02", 1.0, 2.0, None))
    segments = {c: _sequence(spark, ["HIGH"], registry, camera=c)[0].road_segment for c in ("cam_01", "cam_02", "cam_03")}
    assert segments == {"cam_01": "A1", "cam_02": None, "cam_03": "cam_03"}


def test_j5_slices_against_plain_python(spark):
    rng = random.Random(11)
    rows = []
    for camera in ("a", "b", "c"):
        level = "LOW"
        for n in range(200):
            if rng.random() < 0.25:
                level = rng.choice(["LOW", "MODERATE", "HIGH", "SEVERE"])
            if rng.random() < 0.8:
                rows.append(metric(camera, n, level, round(rng.random(), 4)))
    want = set()
    for camera in ("a", "b", "c"):
        opened = None
        for r in [r for r in rows if r["camera_id"] == camera]:
            if r["congestion_level"] in ("HIGH", "SEVERE"):
                start = opened[0] if opened else r["window_end"]
                opened = (start, r["congestion_level"], r["congestion_score"])
            elif opened:
                want.add((camera, _naive(opened[0]), _naive(r["window_end"]), *opened[1:]))
                opened = None
        if opened:
            want.add((camera, _naive(opened[0]), None, *opened[1:]))
    for width in (5, 15, 60, 86_400):
        found = al.alerts_from_metrics(metrics(spark, rows), cameras(spark), width).collect()
        got = {(r.camera_id, r.triggered_at, r.resolved_at, r.congestion_level, r.congestion_score) for r in found}
        assert got == want and len(found) == len(want)


def _three_alerts(spark):
    rows = [metric(c, 0, "HIGH") for c in ("a", "b", "c")] + [metric("a", 1, "LOW")]
    return al.alerts_from_metrics(metrics(spark, rows), cameras(spark))


def test_k3_first_acknowledgement_wins(spark):
    alerts = _three_alerts(spark)
    ids = {r.camera_id: r.alert_id for r in alerts.collect()}
    requests = acks(
        spark, (1, ids["a"], "late", at(200)), (2, ids["a"], "early", at(100)), (3, "none", "x", at(1)),
        (4, ids["b"], "bob", at(50)),
    )
    status = {r.ack_id: (r.status, r.admin_id) for r in al.ack_results(alerts, requests).collect()}
    assert status == {
        1: ("already_acknowledged", "early"), 2: ("acknowledged", "early"), 3: ("not_found", None), 4: ("acknowledged", "bob"),
    }
    acked = al.acknowledge(alerts, requests)
    assert {r.camera_id: r.acknowledged_by for r in acked.collect()} == {"a": "early", "b": "bob", "c": None}
    again = al.acknowledge(acked, acks(spark, (9, ids["a"], "other", at(1))))
    assert again.filter("camera_id = 'a'").first().acknowledged_by == "early"
    assert one(al.unacknowledged(acked)).camera_id == "c"
    assert {r.camera_id for r in al.unresolved(acked).collect()} == {"b", "c"}
    assert al.alert_history(acked, severity="warning", camera_id="b").first().acknowledged is True
    assert al.alert_history(acked, end=at(1)).count() == 0


def test_b4_export(spark, tmp_path):
    al.export_alerts_csv(_three_alerts(spark), str(tmp_path / "out"))
    lines = [row for f in glob.glob(f"{tmp_path}/out/*.csv") for row in csv.DictReader(open(f))]
    assert len(lines) == 3 and tuple(lines[0]) == al.EXPORT_COLUMNS
    assert sorted(bool(row["resolved_at"]) for row in lines) == [False, False, True]


def test_j6_once_per_window(spark):
    rows = [metric(n=0, level="HIGH"), metric(n=0, level="HIGH"), metric(n=1, level="LOW"), metric(n=2, level="SEVERE"),
            metric(n=3, level="SEVERE", lane=1)]
    assert sorted(r.severity for r in al.new_alerts(metrics(spark, rows)).collect()) == ["HIGH", "SEVERE"]
