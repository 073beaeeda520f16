import random

import pytest
from pyspark.sql import functions as F

from roadpulse.config import Episode, ForecastWindow
from roadpulse.operators import episodes as ep
from roadpulse.operators import features as ft
from roadpulse.operators import forecast_ml as ml
from roadpulse.operators import graph as gr
from roadpulse.operators import trend as tr
from roadpulse.operators.gapfill import fill_gaps
from roadpulse.schemas import CROSS_EDGE, FORECAST
from roadpulse.sources.topology import topology_tables
from tests.data import at, metric, metrics, one


def _scores(spark, values, camera="a"):
    return metrics(spark, [metric(camera, n, score=v) for n, v in enumerate(values)])


def test_f7_empty_history(spark):
    roster = spark.createDataFrame([("a",)], "camera_id STRING")
    points = tr.ewma_forecast(metrics(spark, []), horizon=3, roster=roster).collect()
    assert [(p.step, p.congestion_score, p.congestion_level) for p in points] == [(i, 0.0, "LOW") for i in (1, 2, 3)]
    assert tr.ewma_forecast(_scores(spark, [0.1]), horizon=0).count() == 0


def test_f7_trends_and_bounds(spark):
    points = tr.ewma_forecast(_scores(spark, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6])).orderBy("step").collect()
    scores = [p.congestion_score for p in points]
    assert scores == sorted(scores) and scores[0] >= 0.5
    assert all(0 <= p.congestion_score <= 1 for p in tr.ewma_forecast(_scores(spark, [0.95] * 10)).collect())


def test_f5_f6_slices_against_plain_python(spark):
    rng = random.Random(2)
    values = [round(rng.random(), 4) for _ in range(40)]
    level = values[0]
    for v in values[1:]:
        level = 0.4 * v + 0.6 * level
    tail = values[-6:]
    slope = sum((i - 2.5) * (v - sum(tail) / 6) for i, v in enumerate(tail)) / 17.5
    for width in (5, 10, 35, 86_400):
        assert abs(one(tr.ewma(_scores(spark, values), slice_seconds=width)).level - level) < 1e-9
        assert abs(one(tr.trend(_scores(spark, values), slice_seconds=width)).slope - slope) < 1e-9
    assert one(tr.trend(_scores(spark, [0.5]))).slope == 0.0


def test_f3_against_plain_python(spark):
    rng = random.Random(8)
    rows = []
    for lane in (1, 2):
        for n in range(60):
            if rng.random() < 0.4:
                shift = 1 if rng.random() < 0.2 and n else 0
                rows.append(metric("a", n, lane=lane, count=rng.choice([None, n]), window_start=at(n * 5 + shift)))
    want = set()
    for lane in (1, 2):
        mine = {r["window_start"]: r for r in rows if r["lane_id"] == lane}
        now, last, count = min(mine), max(mine), None
        while now <= last:
            if now in mine and mine[now]["vehicle_count"] is not None:
                count = mine[now]["vehicle_count"]
            # The grid ends at the last window that lies on it or before it.
            want.add((lane, now.replace(tzinfo=None), count))
            now += at(5) - at(0)
    on_grid = [max(w for lane, w, _ in want if lane == k) for k in (1, 2)]
    got_by_width = []
    for width in (5, 15, 50, 86_400):
        got = {(r.lane_id, r.window_start, r.vehicle_count) for r in fill_gaps(metrics(spark, rows), 5, width).collect()}
        got_by_width.append(got)
        ends = {lane: max(w for k, w, _ in got if k == lane) for lane in (1, 2)}
        assert got == {w for w in want if w[1] <= ends[w[0]]}
        assert all(ends[lane] <= end for lane, end in zip((1, 2), on_grid))
    assert all(g == got_by_width[0] for g in got_by_width)


def _series(spark, *series, step_seconds=5, level="LOW"):
    rows = [
        ("cam", lane, at(0), step, at((step + 1) * step_seconds), float(step), p, level)
        for lane, values in enumerate(series, 1)
        for step, p in enumerate(values)
    ]
    return spark.createDataFrame(rows, FORECAST)


def _first_run(values, holds, steps, begin=0):
    """Where the first ``steps`` values in a row hold."""
    for i in range(begin, len(values) - steps + 1):
        if all(map(holds, values[i : i + steps])):
            return i
    return None


@pytest.mark.parametrize("seed", range(3))
def test_f11(spark, seed):
    rng = random.Random(seed)
    series = [[round(rng.random(), 2) for _ in range(rng.randint(1, 14))] for _ in range(12)] + [[0.02] * 7]
    for condition, holds in (("congestion_prob >= 0.45", lambda p: p >= 0.45), ("congestion_prob <= 0.35", lambda p: p <= 0.35)):
        for steps in (1, 2, 3):
            got = ep.first_sustained(_series(spark, *series), F.expr(condition), steps).collect()
            want = {lane: _first_run(values, holds, steps) for lane, values in enumerate(series, 1)}
            assert {r.lane_id: r.step for r in got} == want


def test_f12(spark):
    rng = random.Random(12)
    series = [[rng.choice([0.05, 0.22, 0.48, 0.58, 0.83]) for _ in range(rng.randint(4, 25))] for _ in range(20)]
    series += [[0.03] * 9, [0.91] * 4 + [0.12] * 6, [0.12] * 6 + [0.91] * 4]
    rows = {r.lane_id: r for r in ep.episodes(_series(spark, *series), Episode(step_seconds=5)).collect()}
    for lane, values in enumerate(series, 1):
        start = _first_run(values, lambda p: p >= 0.55, 3)
        end = _first_run(values, lambda p: p <= 0.30, 3, start + 1 if start is not None else 0)
        assert rows[lane].start_step == start
        if start is not None:
            assert rows[lane].end_step == end
            assert rows[lane].peak_probability == max(values[start:end])
            assert rows[lane].congestion_start == at(5 * (start + 1)).replace(tzinfo=None)


def test_f14_f15_f16(spark):
    fc = _series(spark, [0.7] * 120, level="HIGH")
    summary = one(ep.lane_summary(fc))
    assert (summary.current_congestion_level, summary.next_5min_avg_count) == ("HIGH", 29.5)
    assert one(ep.congestion_outlook(fc)).predicted_levels == ["HIGH"] * 10
    detail = one(ep.lane_detail(fc, "cam", 1, steps=60))
    assert len(detail.congestion_probabilities) == 60 and detail.predicted_vehicle_counts[:2] == [0.0, 1.0]
    with pytest.raises(LookupError):
        ep.lane_detail(fc, "cam", 9)
    message = one(ep.forecast_messages(fc, at(0)).selectExpr("value", "get_json_object(value, '$.num_lanes') n"))
    assert message.n == "1" and '"congestion_end":null' in message.value


def test_e20_mean_of_lanes(spark):
    fc = _series(spark, [0.2] * 130, [0.22] * 130)
    points = ep.camera_forecast(fc, 120).orderBy("step").collect()
    assert len(points) == 120 and (points[0].step, points[0].congestion_score) == (1, 0.21)
    assert ep.camera_forecast(_series(spark, [0.2] * 9, [0.3] * 4), 120).count() == 4
    rows = metrics(spark, [metric(lane=1), metric(n=1, lane=2), metric()])
    assert one(ep.history_samples(rows, at(60), 10)).history_samples == 2


def test_f17_decode(spark):
    scored = spark.createDataFrame(
        [("c", 1, at(0), 0, 0.5, 0.4, [0.1, 0.7, 0.2]), ("c", 1, at(0), 1, 0.1, 0.4, [0.3, 0.3, 0.1])],
        "camera_id STRING, lane_id INT, origin TIMESTAMP, step INT, count_norm DOUBLE, congestion_prob DOUBLE, level_scores ARRAY<DOUBLE>",
    )
    rows = ep.decode_forecast(scored, 700, 300).orderBy("step").collect()
    assert [(r.vehicle_count, r.congestion_level) for r in rows] == [(350.0, "MEDIUM"), (70.0, "LOW")]
    assert rows[0].predicted_at == at(300).replace(tzinfo=None)


SPEC = {
    "cameras": [{"camera_id": "z", "lane_ids": [1, 2, 3]}, {"camera_id": "a", "lane_ids": [5, 4, 5]}],
    "cross_camera_edges": [
        {"from_camera": "z", "from_lane": 3, "to_camera": "a", "to_lane": 5},
        {"from_camera": "z", "from_lane": 9, "to_camera": "a", "to_lane": 5},
    ],
}


def test_h1_h2_h3(spark):
    lanes, cross = topology_tables(spark, SPEC)
    nodes = gr.lane_nodes(lanes)
    index = {(r.camera_id, r.lane_id): r.node for r in nodes.collect()}
    assert index == {("z", 1): 0, ("z", 2): 1, ("z", 3): 2, ("a", 5): 3, ("a", 4): 4}
    edges = gr.require_edges(gr.lane_edges(nodes, lanes, cross))
    pairs = {(r.src, r.dst) for r in edges.collect()}
    assert pairs == {(i, i) for i in range(5)} | {(a + d, b + d) for x, y in [(0, 1), (1, 2), (2, 3), (3, 4)]
                                                  for a, b, d in [(x, y, 0), (y, x, 0)]}
    hops = {(r.src, r.dst): r.hops for r in gr.khop(edges, 3).collect()}
    assert hops[(0, 0)] == 0 and hops[(0, 3)] == 3 and (0, 4) not in hops
    with pytest.raises(ValueError):
        gr.require_edges(edges.limit(0))


def _lane_rows(spark, steps, lanes=((("z"), 1), (("z"), 2), (("a"), 5)), unknown=True):
    rows = [
        metric(c, n, ["LOW", "MODERATE", "HIGH"][(n + lane) % 3], round(0.1 * ((n + lane) % 9), 2), lane, count=n % 7 * 10)
        for c, lane in lanes for n in range(steps)
    ]
    if unknown:
        rows.append(metric("nowhere", 0, lane=1))
    return metrics(spark, rows)


WINDOW = ForecastWindow(t_in=6, t_out=12, step_seconds=5, hops=1)


def test_f8_f9_f10(spark):
    lanes, _ = topology_tables(spark, SPEC)
    nodes = gr.lane_nodes(lanes)
    dense = ft.dense_signal(ft.features(_lane_rows(spark, 30), WINDOW), nodes)
    assert dense.count() == 30 * 5 and dense.filter("node = 1 and t_idx = 29").first().vehicle_count > 0
    assert dense.filter("node in (2, 4)").agg(F.sum("vehicle_count")).first()[0] == 0.0
    samples = ft.sliding_samples(dense, 6, 12)
    assert samples.count() == 13 * 5
    first = samples.filter("node = 0 and start = 12").first()
    assert len(first.x) == 6 and len(first.x[0]) == 8 and len(first.y_congestion_prob) == 12
    for width in (18, 25):
        assert samples.exceptAll(ft.sliding_samples(dense, 6, 12, slice_steps=width)).count() == 0
    with pytest.raises(ValueError):
        ft.sliding_samples(ft.dense_signal(ft.features(_lane_rows(spark, 10), WINDOW), nodes), 6, 12)
    assert ft.recent_input(ft.features(_lane_rows(spark, 30), WINDOW), nodes, 6).count() == 6 * 5
    assert ft.recent_input(ft.features(_lane_rows(spark, 5), WINDOW), nodes, 6).count() == 0


def test_l1_to_l7(spark, tmp_path):
    window = ForecastWindow(t_in=3, t_out=2, step_seconds=5, hops=1)
    lanes, cross = topology_tables(spark, SPEC)
    nodes = gr.lane_nodes(lanes)
    edges = gr.lane_edges(nodes, lanes, cross)
    dense = ft.dense_signal(ft.features(_lane_rows(spark, 60, unknown=False), window), nodes)
    dense.write.parquet(str(tmp_path / "dense"))
    dense = spark.read.parquet(str(tmp_path / "dense"))
    table = ml.training_table(dense, edges, window)
    assert table.count() == 5 * (60 - 3 - 2 + 1) * 2
    parts = ml.split(table)
    assert sum(p.count() for p in parts) == table.count()
    starts = [{r.start for r in p.select("start").distinct().collect()} for p in parts]
    assert not (starts[0] & starts[1] or starts[0] & starts[2] or starts[1] & starts[2])
    train, _, test = ml.split_by_time(table, gap=5)
    assert train.agg(F.max("start")).first()[0] + 5 < test.agg(F.min("start")).first()[0]
    model = ml.fit_forecaster(train, window, iterations=5)
    quality = one(ml.evaluate(model, test))
    assert 0 <= quality.level_acc <= 1 and quality.count_mae < 0.1
    ml.save_model(model, str(tmp_path / "model"))
    again = ml.load_model(str(tmp_path / "model"))
    a, b = (ml.predict_lanes(m, dense, nodes, edges, window).orderBy("camera_id", "lane_id", "step").collect() for m in (model, again))
    assert a == b and len(a) == 5 * 2
    assert all(r.vehicle_count >= 0 and 0 <= r.congestion_prob <= 1 for r in a)
    assert a[0].predicted_at == at(59 * 5 + 5).replace(tzinfo=None)


def test_d10_a5_sensors(spark, tmp_path):
    from roadpulse.schemas import SENSOR_MAP, SENSOR_READING
    from roadpulse.sources import sensors as sn

    mapping = spark.createDataFrame([(1, "a", 1), (2, "a", 2), (3, "b", 1)], SENSOR_MAP)
    readings = spark.createDataFrame([(at(0), 1, 350.5, 0.5, 55.0), (at(0), 9, 1.0, 0.1, 1.0), (at(0), 3, -4.0, 1.7, -1.0)], SENSOR_READING)
    rows = {r.camera_id: r for r in sn.import_sensor_series(readings, mapping).collect()}
    assert (rows["a"].vehicle_count, rows["a"].queue_length, rows["a"].counts_by_class) == (350, 15, {"car": 350})
    assert (rows["a"].congestion_score, rows["a"].congestion_level) == (0.5, "MODERATE")
    assert (rows["b"].vehicle_count, rows["b"].stopped_ratio, rows["b"].avg_speed_kmh) == (0, 1.0, 0.0)
    (tmp_path / "e.csv").write_text("from,to,cost\n1,2,3.5\n2,3,1\n3,7,1\n")
    links = sn.map_adjacency(sn.read_adjacency(spark, str(tmp_path / "e.csv")), mapping).collect()
    assert {(r.from_camera, r.to_camera, r.kind) for r in links} == {("a", "a", "intra"), ("a", "b", "cross")}
    assert CROSS_EDGE.fieldNames() == [f for f in links[0].asDict() if f != "kind"]
