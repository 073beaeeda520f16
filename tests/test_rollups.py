"""Merged sketches, the maintained roll-up, the tiled grid and Chebyshev features."""

import random
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.operators import analytics as an
from roadpulse.operators import features as ft
from roadpulse.operators import graph as gr
from roadpulse.operators import rollups as ru
from roadpulse.operators import sketches as sk
from roadpulse.operators.windows import window_metrics
from roadpulse.plans.journal import Journal
from roadpulse.streaming import upserts as sup
from tests.data import T0, at, cameras, event, events, metric, metrics, one


def test_e2_sketches_merge_to_distinct_counts(spark):
    rng = random.Random(1)
    rows = [event(rng.randrange(7200), f"v{rng.randrange(6000)}", rng.choice("aab"), rng.choice([None, 2.0, 40.0]), rng.choice([None, 1, 2]), frame=i) for i in range(12_000)]
    df = events(spark, rows)
    small = {(r.camera_id, r.lane_id, r.window_start): r for r in sk.sketched_metrics(sk.window_sketches(df, 60)).collect()}
    exact = window_metrics(df, 60).collect()
    assert len(small) == len(exact)
    for r in exact:  # small counts come out exact, and with them all that follows from them
        assert small[r.camera_id, r.lane_id, r.window_start] == r
    wide = sk.window_sketches(df, 60).filter("lane_id IS NULL")
    bound = 4 * sk.standard_error()
    for keys, pick in ((("camera_id", "lane_id"), lambda r: r["camera_id"]), ((), lambda r: None)):
        got = {(r.camera_id, r.window_start): r.vehicle_count for r in sk.sketched_metrics(sk.merge_sketches(wide, 3600, keys)).collect()}
        want = {}
        for r in rows:
            hour = T0 + timedelta(hours=int((r["ts"] - T0).total_seconds() // 3600))
            want.setdefault((pick(r), hour.replace(tzinfo=None)), set()).add(r["vehicle_id"])
        assert got.keys() == want.keys()
        assert all(abs(got[k] - len(v)) <= bound * len(v) for k, v in want.items())


def test_e2_merging_twice_and_no_rows(spark):
    df = events(spark, [event(s, f"v{s % 50}", "a", 2.0) for s in range(300)])
    once = sk.merge_sketches(sk.window_sketches(df, 5), 3600)
    twice = sk.merge_sketches(sk.merge_sketches(sk.window_sketches(df, 5), 60), 3600)
    assert one(sk.sketched_metrics(once)) == one(sk.sketched_metrics(twice)) and one(sk.sketched_metrics(once)).vehicle_count == 50
    assert sk.sketched_metrics(sk.merge_sketches(sk.window_sketches(df.limit(0), 5), 60)).count() == 0


def _batches(seed, n=6):
    rng = random.Random(seed)
    return [
        list({
            (c, w, lane): metric(c, w, rng.choice(["LOW", "MODERATE", "HIGH", "SEVERE"]), round(rng.random(), 4), lane, rng.randrange(30),
                                 round(rng.uniform(0, 90), 2), rng.randrange(5), 300)
            for c in "abc" for w in range(40) for lane in (None, None, 1) if rng.random() < 0.4
        }.values())
        for _ in range(n)
    ]


def _check_answers(hours, table, registry):
    a, b = (at(0).replace(minute=0), at(7200).replace(minute=0)), (at(3600), at(4 * 3600))
    closed = lambda end: end - timedelta(microseconds=1)
    assert one(ru.range_summary(hours, *a)) == pytest.approx(one(an.range_summary(table, a[0], closed(a[1]))))
    both, want = one(ru.compare_ranges(hours, a, b)), one(an.compare_ranges(table, (a[0], closed(a[1])), (b[0], closed(b[1]))))
    assert both.asDict() == pytest.approx({c: want[c] for c in both.asDict()})
    assert one(ru.incident_summary(hours, *b)) == pytest.approx(one(an.incident_summary(table, b[0], closed(b[1]))))
    for got, want in zip(ru.hourly_trends(hours, *b).collect(), an.hourly_trends(table, b[0], closed(b[1])).collect(), strict=True):
        assert tuple(got) == pytest.approx(tuple(want))
    for got, want in zip(ru.top_segments(hours, registry, *b).collect(), an.top_segments(table, registry, b[0], closed(b[1])).collect(), strict=True):
        assert got.segment_key == want.segment_key and tuple(got)[1:] == pytest.approx(tuple(want)[1:])


def test_e8_e13_rollup_follows_upserts(spark, tmp_path):
    """After every batch, some replayed, all answers equal those from the whole table; the roll-up is folded on the way."""
    table, hours, registry = f"{tmp_path}/t", f"{tmp_path}/h", cameras(spark, ("a", 1.0, 2.0, "A"), ("b", 1.0, 2.0, "A"))
    for n, rows in enumerate(_batches(4, 4)):
        for _ in range(1 + n % 2):
            sup.log_batch_and_hours(metrics(spark, rows), table, hours, n)
        if n == 2:
            assert sup.compact_upserts(spark, hours, at(5 * 86_400).date(), sup.HOURS) > 0
            sup.compact_upserts(spark, table, at(5 * 86_400).date())
            sup.log_batch_and_hours(metrics(spark, rows), table, hours, n)
    _check_answers(sup.read_hours(spark, hours), sup.read_upserted(spark, table).drop("date"), registry)
    assert sup.read_hours(spark, hours).exceptAll(ru.hour_shares(sup.read_upserted(spark, table))).count() == 0
    with pytest.raises(ValueError, match="whole hour"):
        ru.range_summary(sup.read_hours(spark, hours), at(1), at(3600))


@pytest.mark.parametrize("call", [1, 2])
def test_e8_a_batch_that_is_stopped_and_comes_again(spark, tmp_path, monkeypatch, call):
    """Stopped before its difference is committed, or between that and the batch itself."""
    table, hours, put, calls = f"{tmp_path}/t", f"{tmp_path}/h", Journal.put, [0]
    first, second = _batches(5, 2)
    sup.log_batch_and_hours(metrics(spark, first), table, hours, 0)

    def stopped(self, name, value=None):
        calls[0] += 1
        if calls[0] == call:
            raise InterruptedError
        return put(self, name, value)

    monkeypatch.setattr(Journal, "put", stopped)
    with pytest.raises(InterruptedError):
        sup.log_batch_and_hours(metrics(spark, second), table, hours, 1)
    monkeypatch.undo()
    sup.log_batch_and_hours(metrics(spark, second), table, hours, 1)
    want = ru.hour_shares(sup.read_upserted(spark, table))
    assert sup.read_hours(spark, hours).exceptAll(want).count() == 0 and want.exceptAll(sup.read_hours(spark, hours)).count() == 0


def test_f9_tiles_of_any_size_give_the_same_grid(spark):
    nodes = spark.createDataFrame([(i, f"c{i // 3}", i % 3) for i in range(10)], "node long, camera_id string, lane_id int")
    rng = random.Random(2)
    rows = [metric(f"c{rng.randrange(5)}", w, lane=rng.randrange(4)) for w in range(30)]
    df = ft.features(metrics(spark, list({(r["camera_id"], r["lane_id"], r["window_start"]): r for r in rows}.values())))
    whole = ft.dense_signal(df, nodes)
    assert whole.count() == 300 and whole.select("t_idx", "node").distinct().count() == 300
    for size in (1, 9, 50):
        tiled = ft.dense_signal(df, nodes, size)
        assert tiled.exceptAll(whole).count() == 0 and tiled.count() == 300
    assert ft.dense_signal(df, nodes.limit(0)).count() == 0 and ft.dense_signal(df.limit(0), nodes).count() == 0


def test_h3_chebyshev_equals_the_dense_polynomials(spark):
    rng = np.random.default_rng(3)
    n, pairs = 8, {(0, 1), (1, 2), (2, 3), (1, 4), (4, 5), (5, 0)}  # nodes 6 and 7 have no neighbours
    edges = [(a, b) for x, y in pairs for a, b in ((x, y), (y, x))] + [(i, i) for i in range(n)] + [(0, 1)]
    x = rng.normal(size=(3, n, 2))
    signal = spark.createDataFrame([(t, i, float(x[t, i, 0]), float(x[t, i, 1])) for t in range(3) for i in range(n)], "t_idx long, node long, a double, b double")
    adjacency = np.zeros((n, n))
    for a, b in pairs:
        adjacency[a, b] = adjacency[b, a] = 1
    degree = adjacency.sum(1)
    norm = np.divide(1, np.sqrt(degree), out=np.zeros(n), where=degree > 0)
    for largest in (2.0, 1.6):
        scaled = 2 / largest * (np.eye(n) - norm[:, None] * adjacency * norm) - np.eye(n)
        poly = [np.eye(n), scaled, 2 * scaled @ scaled - np.eye(n)]
        poly.append(2 * scaled @ poly[2] - poly[1])
        got = gr.chebyshev_features(signal, spark.createDataFrame(edges, "src long, dst long"), ["a", "b"], 4, largest).collect()
        assert len(got) == 3 * n
        for r in got:
            for k in (1, 2, 3):
                want = poly[k] @ x[r.t_idx]
                assert (r[f"a_cheb{k}"], r[f"b_cheb{k}"]) == pytest.approx(tuple(want[r.node]))
    assert gr.chebyshev_features(signal, spark.createDataFrame(edges, "src long, dst long"), ["a"], 1).columns == signal.columns
    none = gr.chebyshev_features(signal, spark.createDataFrame([], "src long, dst long"), ["a"], 2)
    assert none.filter(F.abs(F.col("a_cheb1")) > 1e-12).count() == 0
