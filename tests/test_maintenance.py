import glob
import random

import pytest
from pyspark.sql import functions as F

from roadpulse.config import Thresholds
from roadpulse.operators import maintenance as mt
from roadpulse.schemas import CAMERA_CHANGE, THRESHOLD_ROW
from tests.data import at, cameras, event, events, metric, metrics, one


def test_b2_null_lane_is_one_value(spark):
    old = metrics(spark, [metric(n=0, count=1), metric(n=0, lane=1, count=2), metric(n=1, count=3)])
    new = metrics(spark, [metric(n=0, count=10), metric(n=2, lane=1, count=30)])
    got = {(r.lane_id, r.window_start.second): r.vehicle_count for r in mt.upsert_metrics(old, new).collect()}
    assert got == {(None, 0): 10, (1, 0): 2, (None, 5): 3, (1, 10): 30}


def test_k1_b3_retention(spark, tmp_path):
    day = 86_400
    seen = events(spark, [event(-48 * 3600), event(-3600)])
    rows = metrics(spark, [metric("cam/1", -45, step=day), metric("cam/1", -1, step=day)])
    parts = mt.sweep(seen, rows, at(0))
    assert (one(parts["deleted"]).events_deleted, one(parts["deleted"]).metrics_deleted) == (1, 1)
    assert parts["events_kept"].count() == 1 and parts["metrics_kept"].count() == 1
    mt.archive_metrics(parts["archive"].drop("date"), str(tmp_path / "archive"))
    (folder,) = glob.glob(f"{tmp_path}/archive/camera_id=*/date=*")
    assert "cam%2F1" in folder and folder.endswith("date=2026-03-02")
    back = one(spark.read.parquet(str(tmp_path / "archive")))
    assert (back.camera_id, back.counts_by_class, len(back)) == ("cam/1", '{"car":10}', 12)


def test_c16_thresholds(spark):
    table = spark.createDataFrame([(2, 0.5, 0.6, 0.7), (1, 0.05, 0.1, 0.2)], THRESHOLD_ROW)
    assert mt.resolve_thresholds(table) == Thresholds(0.05, 0.1, 0.2)
    assert mt.resolve_thresholds(table.limit(0)) == Thresholds()
    with pytest.raises(ValueError):
        mt.resolve_thresholds(spark.createDataFrame([(1, 0.6, 0.5, 0.9)], THRESHOLD_ROW))
    with pytest.raises(ValueError):
        Thresholds(0.1, 0.2, 1.5)
    rows = metrics(spark, [metric(count=10, speed=40.0)])
    assert one(mt.reclassify(rows, table)).congestion_level == "SEVERE"
    assert one(mt.reclassify(rows, table.limit(0))).congestion_level == "LOW"


def _change(seq, action, camera="x", **fields):
    return (
        seq, "admin", action, camera, fields.get("name"), fields.get("lat"), fields.get("lng"), fields.get("segment"),
        fields.get("description"), at(seq),
    )


def _apply(spark, registry, changes, **options):
    judged = mt.judge_camera_changes(registry, spark.createDataFrame(changes, CAMERA_CHANGE), **options)
    after = {r.camera_id: r for r in mt.apply_camera_changes(registry, judged).collect()}
    return {r.seq: r.status for r in judged.collect()}, after, judged


def test_k2_partial_update_keeps_the_rest(spark):
    registry = cameras(spark, ("x", 1.0, 2.0, "old"))
    status, after, _ = _apply(spark, registry, [_change(1, "update", segment="new")])
    assert status == {1: "applied"}
    assert (after["x"].road_segment, after["x"].latitude, after["x"].name) == ("new", 1.0, "x")


def test_k2_rules(spark):
    registry = cameras(spark, ("x", 1.0, 2.0, "old"))
    status, after, judged = _apply(
        spark,
        registry,
        [
            _change(1, "create", name="X", lat=1.0, lng=1.0),
            _change(2, "update", "new", segment="s"),
            _change(3, "update", "new", lat=5.0, lng=6.0, segment="s"),
            _change(4, "delete", "gone"),
            _change(5, "create", "bad", name="B", lat=95.0, lng=1.0),
            _change(6, "create", "half", name="H", lat=5.0),
            _change(7, "create", "ok", name="O" * 200, lat=-90.0, lng=180.0),
            _change(8, "create", "long", name="O" * 201, lat=5.0, lng=1.0),
            _change(9, "delete"),
            _change(10, "paint", "ok"),
        ],
    )
    assert status == {
        1: "rejected: already_exists", 2: "rejected: not_found", 3: "applied", 4: "rejected: not_found",
        5: "rejected: bad_latitude", 6: "rejected: incomplete", 7: "applied", 8: "rejected: bad_name", 9: "applied",
        10: "rejected: unknown_action",
    }
    assert set(after) == {"new", "ok"} and (after["new"].name, after["new"].latitude) == ("new", 5.0)
    audit = {r.entity_id: r for r in mt.audit_rows(judged).collect()}
    assert set(audit) == {"new", "ok", "x"} and audit["x"].payload is None
    assert audit["x"].action == "cameras.delete" and '"latitude":5.0' in audit["new"].payload


def test_k2_sequences_against_plain_python(spark):
    rng = random.Random(4)
    changes = []
    for seq in range(300):
        fields = {}
        if rng.random() < 0.5:
            fields |= dict(lat=float(rng.randrange(90)), lng=float(rng.randrange(180)))
        if rng.random() < 0.5:
            fields["name"] = f"n{seq}"
        if rng.random() < 0.4:
            fields["segment"] = f"s{seq}"
        changes.append(_change(seq, rng.choice(["create", "update", "update", "delete"]), rng.choice("abc"), **fields))
    state, want = {"a": ["a", 1.0, 2.0, "old"]}, {}
    for seq, _, action, camera, name, lat, lng, segment, *_ in changes:
        known, located = camera in state, lat is not None and lng is not None
        if action == "create":
            ok = located and name is not None and not known
        else:
            ok = known or (action == "update" and located)
        want[seq] = ok
        if not ok:
            continue
        if action == "delete":
            del state[camera]
            continue
        old = state.get(camera, [camera, None, None, None])
        state[camera] = [new if new is not None else kept for new, kept in zip((name, lat, lng, segment), old)]
    for slice_rows in (7, 100, 10_000):
        status, after, _ = _apply(spark, cameras(spark, ("a", 1.0, 2.0, "old")), changes, slice_rows=slice_rows)
        assert {s: v == "applied" for s, v in status.items()} == want
        assert {c: [r.name, r.latitude, r.longitude, r.road_segment] for c, r in after.items()} == state


def test_c20_aliases(spark):
    offered = spark.createDataFrame(
        [("a", "A", 1.0, 2.0), ("b", "", 1.0, 2.0), ("c", "C", 91.0, 2.0), ("d", "D", None, 2.0)],
        "camera_id STRING, name STRING, lat DOUBLE, lng DOUBLE",
    ).selectExpr("*", "cast(null as string) road_segment", "cast(null as string) description")
    assert [(r.camera_id, r.latitude) for r in mt.valid_cameras(offered).collect()] == [("a", 1.0)]


def test_k2_changes_without_a_camera_or_a_place_and_cleared_fields(spark):
    registry = cameras(spark, ("a", 1.0, 2.0, "A"), ("b", 1.0, 2.0, "B"))
    schema = (
        "seq long, actor string, action string, camera_id string, name string, latitude double, longitude double, "
        "road_segment string, description string, cleared array<string>, changed_at timestamp"
    )
    blank = (None, None, None, None, None)
    changes = spark.createDataFrame(
        [
            (1, "x", "delete", None, *blank, None, None),
            (None, "x", "delete", "a", *blank, None, None),
            (2, "x", "update", "a", *blank, ["road_segment"], None),
            (3, "x", "update", "b", "new", None, None, None, None, None, None),
        ],
        schema,
    )
    judged = mt.judge_camera_changes(registry, changes)
    assert sorted((str(r.seq), str(r.camera_id), r.status) for r in judged.collect()) == [
        ("1", "None", "rejected: bad_camera_id"), ("2", "a", "applied"), ("3", "b", "applied"), ("None", "a", "rejected: bad_seq"),
    ]
    after = {r.camera_id: r for r in mt.apply_camera_changes(registry, judged).collect()}
    assert (after["a"].road_segment, after["a"].name, after["b"].road_segment, after["b"].name) == (None, "a", "B", "new")
    assert '"cleared":["road_segment"]' in {r.entity_id: r.payload for r in mt.audit_rows(judged).collect()}["a"]
