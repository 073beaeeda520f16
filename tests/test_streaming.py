"""Streams over files, drained with ``availableNow`` and compared with the batch operators."""

import os
import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from roadpulse.config import ForecastWindow, Scoring, SpeedFallback
from roadpulse.operators import alerts as al
from roadpulse.operators import features as ft
from roadpulse.operators import forecast_ml as ml
from roadpulse.operators import graph as gr
from roadpulse.operators.speed import fill_speed
from roadpulse.operators.windows import window_metrics
from roadpulse.sources.topology import topology_tables
from roadpulse.streaming import alerts as sal
from roadpulse.streaming import events as sev
from roadpulse.streaming import metrics as smt
from roadpulse.streaming import sinks as ssk
from roadpulse.streaming import speed as ssp
from roadpulse.streaming.forecast import stream_forecast
from roadpulse.streaming.ingest import ingest, read_reject_counts
from roadpulse.streaming.stats import StatsListener, read_stats, stats_table
from tests.data import at, cameras, event, events, message, messages, metric, metrics, one


def _rows(n, seconds, seed=1):
    rng = random.Random(seed)
    rows = [
        event(
            rng.randrange(seconds), f"v{rng.randrange(5)}", f"cam_{rng.choice('0012')}", rng.choice([None, 2.0, 30.0]),
            rng.choice([None, 1, 2]), x=rng.uniform(0, 99), y=rng.uniform(0, 99), frame=i,
        )
        for i, _ in enumerate(range(n))
    ]
    return sorted(rows, key=lambda r: (r["ts"], r["frame_id"]))


def _files(spark, folder, rows, pieces, build=events):
    """Write rows as several files, in order, so that a stream takes one per batch."""
    size = -(-len(rows) // pieces)
    for i in range(0, len(rows), size):
        build(spark, rows[i : i + size]).coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _drain(stream, folder):
    query = ssk.write_raw(stream, f"{folder}/t", f"{folder}/c", every=None)
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/t")


def _same(a, b):
    a, b = (df.withColumn("counts_by_class", F.to_json("counts_by_class")) for df in (a, b))
    return a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def test_j1_j2_stream_equals_batch(spark, tmp_path):
    rows = _rows(300, 60) + [event(100, frame=999)]
    _files(spark, f"{tmp_path}/in", rows, 3)
    got = _drain(smt.stream_metrics(_stream(spark, f"{tmp_path}/in"), 5), f"{tmp_path}/out")
    assert _same(got, window_metrics(events(spark, rows[:-1])))


def test_j12_rollup_on_the_same_stream(spark, tmp_path):
    rows = _rows(200, 50) + [event(300, frame=999)]
    _files(spark, f"{tmp_path}/in", rows, 2)
    got = _drain(smt.stream_rollup(_stream(spark, f"{tmp_path}/in"), 5, 60), f"{tmp_path}/out")
    want = window_metrics(events(spark, rows[:-1])).filter("lane_id is null").groupBy("camera_id").agg(F.sum("vehicle_count"))
    assert {r.camera_id: r.vehicle_count for r in got.collect()} == {r[0]: r[1] for r in want.collect()}


def test_j3_state_equals_lag(spark, tmp_path):
    rows = _rows(200, 400, seed=7)
    _files(spark, f"{tmp_path}/in", rows, 3)
    config = SpeedFallback(ttl_seconds=30)
    got = _drain(ssp.stream_fill_speed(_stream(spark, f"{tmp_path}/in"), {"cam_0": 0.1}, config), f"{tmp_path}/out")
    want = {r.frame_id: r.speed_kmh for r in fill_speed(events(spark, rows), {"cam_0": 0.1}, config).collect()}
    speeds = {r.frame_id: r.speed_kmh for r in got.collect()}
    assert speeds.keys() == want.keys()
    for frame, speed in want.items():
        assert (speed is None) == (speeds[frame] is None) and (speed is None or abs(speed - speeds[frame]) < 1e-6)


def test_j3_slices_hand_on_the_border_sighting(spark, tmp_path):
    """Slices of two lifetimes, rows of later batches in between, one vehicle with most of them."""
    rows = _rows(300, 900, seed=8)
    for i, r in enumerate(rows):
        r["vehicle_id"] = "hot" if i % 3 else r["vehicle_id"]
    config = SpeedFallback(ttl_seconds=30)
    _files(spark, f"{tmp_path}/in", rows, 6)
    filled = ssp.stream_fill_speed(_stream(spark, f"{tmp_path}/in"), None, config, slices_per_ttl=2)
    got = {r.frame_id: (r.ts, r.speed_kmh) for r in _drain(filled, f"{tmp_path}/out").collect()}
    want = {r.frame_id: (r.ts, r.speed_kmh) for r in fill_speed(events(spark, rows), None, config).collect()}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] for k in want)
    assert all(got[k][1] == (None if want[k][1] is None else pytest.approx(want[k][1])) for k in want)


def test_j3_state_is_kept_per_bucket_not_per_vehicle(spark, tmp_path):
    """Many vehicles, one of them without an id, in two batches: right speeds, and state calls that don't follow their number."""
    rows = [event(i // 20, None if i % 150 == 7 else f"v{i % 150}", frame=i, x=i * 7.0 % 97, y=i * 3.0 % 89) for i in range(600)]
    _files(spark, f"{tmp_path}/in", rows, 2)
    filled = ssp.stream_fill_speed(_stream(spark, f"{tmp_path}/in"), None, SpeedFallback(ttl_seconds=30))
    query = ssk.write_raw(filled, f"{tmp_path}/t", f"{tmp_path}/c", every=None)
    query.awaitTermination()
    got = {r.frame_id: r.speed_kmh for r in spark.read.parquet(f"{tmp_path}/t").collect()}
    want = {r.frame_id: r.speed_kmh for r in fill_speed(events(spark, rows), None, SpeedFallback(ttl_seconds=30)).collect()}
    assert got == {k: None if v is None else pytest.approx(v) for k, v in want.items()} and sum(v is not None for v in want.values()) == 450
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress if p["numInputRows"]]
    assert len(timers) == 2 and 0 < max(timers) <= 64


def test_j3_across_a_clock_change(spark, tmp_path):
    """Two sightings in two batches in the hour that New York skips; the time-zone test runs this under its clocks."""
    for n, second in enumerate((0, 5)):
        row = event(0, frame=n, x=100.0 * n) | {"ts": datetime(2024, 3, 10, 2, 30, second, tzinfo=timezone.utc)}
        events(spark, [row]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    got = _drain(ssp.stream_fill_speed(_stream(spark, f"{tmp_path}/in")), f"{tmp_path}/out").collect()
    assert {r.frame_id: r.speed_kmh for r in got} == {0: None, 1: pytest.approx(3.6)}
    assert [str(r.ts) for r in sorted(got, key=lambda r: r.frame_id)] == ["2024-03-10 02:30:00", "2024-03-10 02:30:05"]


def test_j4_every_record_ends_in_one_table(spark, tmp_path):
    """Accepted and refused rows add up to the input, per reason too, also after each batch has come again."""
    good = [message(frame_id=i) for i in range(7)]
    bad = ["", "[1]", "{", message(confidence=2), message("vehicle_id"), message(**{"class": "tank"}), None, message(frame_id="x")]
    paths = [f"{tmp_path}/{x}" for x in ("ok", "no", "counts")]
    for texts in (good[:4] + bad[:3], good[4:] + bad[3:]):
        messages(spark, texts).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        ingest(_stream(spark, f"{tmp_path}/in"), *paths, f"{tmp_path}/c", every=None).awaitTermination()
        ok, no = spark.read.parquet(paths[0]), spark.read.parquet(paths[1])
        counts = {r.reject_reason: r.records for r in read_reject_counts(spark, paths[2]).collect()}
        assert sorted(r.frame_id for r in ok.collect()) == list(range(7)) and no.count() == len(bad)
        assert counts.pop(None) == 7 and counts == {r[0]: r[1] for r in no.groupBy("reject_reason").count().collect()}

    run()
    for name in os.listdir(f"{tmp_path}/c/commits"):  # as if Spark had stopped before it noted the batches
        if name.strip(".").startswith("1"):
            os.remove(f"{tmp_path}/c/commits/{name}")
    run()


def _level_rows(n=40):
    rng = random.Random(9)
    return [metric(c, i, rng.choice(["LOW", "HIGH", "SEVERE", "SEVERE"])) for i in range(n) for c in ("a", "b")]


def test_j5_state_equals_runs(spark, tmp_path):
    rows = _level_rows()
    _files(spark, f"{tmp_path}/in", rows + [metric("c", 99)], 4, metrics)
    registry = cameras(spark, ("a", 1.0, 2.0, "A"))
    stream = smt.read_metrics_stream(spark, f"{tmp_path}/in", max_files=1)
    changes = _drain(sal.stream_alerts(stream, registry), f"{tmp_path}/out")
    assert {r.change for r in changes.select("change").distinct().collect()} == {"opened", "updated", "resolved"}
    got, want = sal.current_alerts(changes), al.alerts_from_metrics(metrics(spark, rows), registry)
    got = got.select(*want.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_j5_goes_on_from_an_existing_table(spark, tmp_path):
    """Batch over all windows = the table of the first ones + a stream, with its own checkpoint, of the rest."""
    rows = _level_rows(60)
    first, second = [r for r in rows if r["window_start"] < at(150)], [r for r in rows if r["window_start"] >= at(150)]
    registry = cameras(spark, ("a", 1.0, 2.0, "A"))
    table = al.alerts_from_metrics(metrics(spark, first), registry)
    still = table.filter("resolved_at IS NULL")
    assert still.count() >= 1
    own_id = F.when(F.col("resolved_at").isNull(), F.concat(F.lit("old-"), "camera_id")).otherwise(F.col("alert_id"))
    acked = F.when(F.col("resolved_at").isNull(), F.lit("ann"))
    table = table.withColumns({"alert_id": own_id, "acknowledged_by": acked, "acknowledged_at": F.when(acked.isNotNull(), F.col("triggered_at"))})
    table.write.parquet(f"{tmp_path}/table")
    existing = spark.read.parquet(f"{tmp_path}/table")
    _files(spark, f"{tmp_path}/in", second + [metric("c", 99)], 3, metrics)
    stream = smt.read_metrics_stream(spark, f"{tmp_path}/in", max_files=1)
    changes = _drain(sal.stream_alerts(stream, registry, existing), f"{tmp_path}/out")
    got = sal.current_alerts(changes, existing)
    want = al.alerts_from_metrics(metrics(spark, rows), registry)
    plain = [c for c in want.columns if c not in ("alert_id", "acknowledged_by", "acknowledged_at")]
    assert got.select(plain).exceptAll(want.select(plain)).count() == 0 and got.count() == want.count()
    taken = got.filter("alert_id LIKE 'old-%'").collect()
    assert len(taken) == still.count() and all(r.acknowledged_by == "ann" for r in taken)
    assert {r.change for r in changes.filter("alert_id LIKE 'old-%'").collect()} <= {"updated", "resolved"}


def test_j5_a_window_that_comes_in_a_later_batch(spark, tmp_path):
    """Batch 1 holds windows 0 and 2, batch 2 the LOW one between them: two alerts, as in batch."""
    first, second = [metric("a", 0, "HIGH"), metric("a", 2, "HIGH")], [metric("a", 1, "LOW"), metric("b", 30)]
    for rows in (first, second):
        metrics(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    registry = cameras(spark, ("a", 1.0, 2.0, "A"))
    stream = smt.read_metrics_stream(spark, f"{tmp_path}/in", lateness_seconds=20, max_files=1)
    got = sal.current_alerts(_drain(sal.stream_alerts(stream, registry), f"{tmp_path}/out"))
    want = al.alerts_from_metrics(metrics(spark, first + second), registry)
    got = got.select(*want.columns)
    assert got.count() == want.count() == 2 and got.exceptAll(want).count() == 0


def test_j12_alerts_chained_to_the_windows_of_one_stream(spark, tmp_path):
    scoring = Scoring(max_vehicle_count=4.0)
    rows = [
        event(5 * n + k / 10, f"v{n}_{k}", camera, speed=2.0 if n % 5 < 3 else 60.0, lane=1, frame=10 * n + k)
        for n in range(40) for camera in ("a", "b") for k in range(1 + n % 4)
    ]
    rows.append(event(400, frame=9999))
    _files(spark, f"{tmp_path}/in", rows, 5)
    registry = cameras(spark, ("a", 1.0, 2.0, "A"))
    got = _drain(sal.detections_to_alerts(_stream(spark, f"{tmp_path}/in"), registry, scoring=scoring), f"{tmp_path}/out")
    want = al.alerts_from_metrics(window_metrics(events(spark, rows[:-1]), 5, scoring), registry)
    got = sal.current_alerts(got).select(*want.columns)
    assert got.count() == want.count() > 2 and got.exceptAll(want).count() == 0


def test_j6_b6_j8_new_alerts_for_subscribers(spark, tmp_path):
    rows = _level_rows(10)
    _files(spark, f"{tmp_path}/in", rows + rows[-4:], 2, metrics)
    stream = smt.read_metrics_stream(spark, f"{tmp_path}/in", lateness_seconds=60, max_files=1)
    envelopes = _drain(sev.to_envelope(al.new_alerts(stream), "new_alert"), f"{tmp_path}/out")
    loud = sum(r["congestion_level"] != "LOW" for r in rows)
    assert envelopes.count() == loud
    assert sev.select_events(envelopes, "heatmap_update").count() == 0
    assert sev.select_events(envelopes, " new_alert , x", "a").count() == sum(
        r["congestion_level"] != "LOW" and r["camera_id"] == "a" for r in rows
    )
    with pytest.raises(ValueError):
        sev.to_envelope(envelopes, "gossip")


def test_b1_dated_table(spark, tmp_path):
    _files(spark, f"{tmp_path}/in", _rows(20, 60), 1)
    query = ssk.write_raw(_stream(spark, f"{tmp_path}/in"), f"{tmp_path}/t", f"{tmp_path}/c", every=None, dated_by="ts")
    query.awaitTermination()
    assert {str(r.date) for r in spark.read.parquet(f"{tmp_path}/t").select("date").collect()} == {"2026-04-16"}


def test_j7_j9_on_each_batch(spark, tmp_path):
    window = ForecastWindow(t_in=3, t_out=2, step_seconds=5, hops=1)
    lanes, cross = topology_tables(spark, {"cameras": [{"camera_id": "a", "lane_ids": [1, 2]}]})
    nodes = gr.lane_nodes(lanes)
    edges = gr.lane_edges(nodes, lanes, cross)
    rows = [metric("a", n, ["LOW", "MODERATE", "HIGH"][n % 3], lane=lane) for n in range(30) for lane in (None, 1, 2)]
    _files(spark, f"{tmp_path}/in", rows, 1, metrics)
    lane_rows = metrics(spark, [r for r in rows if r["lane_id"]])
    table = ml.training_table(ft.dense_signal(ft.features(lane_rows, window), nodes), edges, window)
    model = ml.fit_forecaster(table, window, iterations=3)
    stream = _stream(spark, f"{tmp_path}/in")
    query = stream_forecast(
        stream, f"{tmp_path}/in", model, nodes, edges, f"{tmp_path}/fc", f"{tmp_path}/c1", 10, window, every=None
    )
    query.awaitTermination()
    messages = spark.read.parquet(f"{tmp_path}/fc")
    assert {r.key for r in messages.collect()} == {"a/1", "a/2"}
    ssk.publish_snapshots(stream, f"{tmp_path}/in", f"{tmp_path}/ev", f"{tmp_path}/c2", every=None).awaitTermination()
    sent = spark.read.parquet(f"{tmp_path}/ev")
    assert {r.event for r in sent.collect()} == {"traffic_metrics_update", "heatmap_update"}
    assert one(sent.filter("event = 'heatmap_update'")).ts == at(150).replace(tzinfo=None)


def test_j7_a_camera_silent_for_days_stays_in_the_snapshot(spark, tmp_path):
    day = 86_400 // 5
    arriving = [[metric("a", 0), metric("b", 0)], [metric("b", 3 * day)], [metric("b", 6 * day), metric("c", 6 * day, lane=1)]]
    for n, rows in enumerate(arriving):
        metrics(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = _stream(spark, f"{tmp_path}/in")
        ssk.publish_snapshots(stream, f"{tmp_path}/in", f"{tmp_path}/ev", f"{tmp_path}/c", every=None).awaitTermination()
        sent = spark.read.parquet(f"{tmp_path}/ev").filter(f"batch = {n} AND event = 'traffic_metrics_update'")
        got = [(r[0], r[1]) for r in sent.select(F.get_json_object("data", "$.camera_id"), F.get_json_object("data", "$.window_start")).collect()]
        assert sorted(r[0] for r in got) == ["a", "b"]
        assert dict(got)["b"][:10] == at(3 * n * 86_400).date().isoformat() and dict(got)["a"][:10] == at(0).date().isoformat()
    assert {r[0] for r in spark.read.parquet(f"{tmp_path}/ev_latest").select("batch").distinct().collect()} == {1, 2}


def test_j11_every_batch_is_kept(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.numRecentProgressUpdates", "2")
    listener = StatsListener(stats_table(spark, f"{tmp_path}/stats"))
    spark.streams.addListener(listener)
    try:
        _files(spark, f"{tmp_path}/in", _rows(60, 60), 5)
        _drain(_stream(spark, f"{tmp_path}/in").select("camera_id"), f"{tmp_path}/out")
        for _ in range(50):
            if os.path.isdir(f"{tmp_path}/stats") and read_stats(spark, f"{tmp_path}/stats").count() >= 5:
                break
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.numRecentProgressUpdates")
    rows = read_stats(spark, f"{tmp_path}/stats").collect()
    assert sorted(r.batch for r in rows) == list(range(5)) and sum(r.input_rows for r in rows) == 60
