"""Windows opened again by late detections, and their alerts."""

import random

import pytest

from roadpulse.config import Scoring
from roadpulse.operators.alerts import alerts_from_metrics
from roadpulse.operators.windows import window_metrics
from roadpulse.plans.journal import Journal
from roadpulse.streaming import late
from tests.data import at, cameras, event, events

SCORING = Scoring(max_vehicle_count=4.0)


def _arrivals(seed, batches):
    """Detections of three cameras over some minutes; a third comes in a later batch than its time says."""
    rng = random.Random(seed)
    rows = [[] for _ in range(batches)]
    for i in range(350):
        second = rng.randrange(240)
        due = second * batches // 240
        n = min(batches - 1, due + rng.choice([0, 0, 0, 1, 2]))
        slow = (second // 25) % 2 and rng.random() < 0.8
        rows[n].append(event(second, f"v{rng.randrange(9)}", rng.choice("abc"), 2.0 if slow else rng.choice([None, 55.0]), rng.choice([None, 1, 2]), frame=i))
    return rows


def _same(a, b):
    text = lambda df: sorted(str(sorted(r.asDict().items())) for r in df.collect())
    return text(a) == text(b)


def _take(spark, rows, tables, n, registry, days=9):
    df = events(spark, rows)
    touched = late.reopen_windows(df, tables, n, days, 5, SCORING)
    if touched is not None:
        late.correct_alerts(touched, registry, tables, n)


def test_j2_after_every_batch_windows_and_alerts_are_those_of_all_rows(spark, tmp_path):
    registry, tables, seen, told = cameras(spark, ("a", 1.0, 2.0, "A")), str(tmp_path), [], set()
    for n, rows in enumerate(_arrivals(1, 4)):
        seen += rows
        _take(spark, rows, tables, n, registry)
        want = window_metrics(events(spark, seen), 5, SCORING)
        assert _same(late.read_late_metrics(spark, tables), want)
        alerts = late.read_late_alerts(spark, tables)
        assert _same(alerts, alerts_from_metrics(want, registry))
        now = {r.alert_id for r in alerts.collect()}
        gone, told = told - now, told | now
    every = late.read_upserted(spark, f"{tables}/alerts", kind=late.ALERTS)
    assert {r.alert_id for r in every.filter("retracted").collect()} == told - now and (gone or told - now)


@pytest.mark.parametrize("call", [1, 2, 3])
def test_j2_a_batch_that_is_stopped_and_comes_again(spark, tmp_path, monkeypatch, call):
    """Stopped before its sums, its windows or its alerts are committed; and taken twice when all went well."""
    registry, tables, put, calls = cameras(spark, ("a", 1.0, 2.0, "A")), str(tmp_path), Journal.put, [0]
    first, second = _arrivals(2, 2)
    _take(spark, first, tables, 0, registry)

    def stopped(self, name, value=None):
        calls[0] += 1
        if calls[0] == call:
            raise InterruptedError
        return put(self, name, value)

    monkeypatch.setattr(Journal, "put", stopped)
    with pytest.raises(InterruptedError):
        _take(spark, second, tables, 1, registry)
    monkeypatch.undo()
    for _ in range(2):
        _take(spark, second, tables, 1, registry)
    want = window_metrics(events(spark, first + second), 5, SCORING)
    assert _same(late.read_late_metrics(spark, tables), want)
    assert _same(late.read_late_alerts(spark, tables), alerts_from_metrics(want, registry))


def test_j2_closed_dates_and_empty_batches(spark, tmp_path):
    registry, tables, day = cameras(spark), str(tmp_path), 86_400
    _take(spark, [], tables, 0, registry)
    _take(spark, [event(0), event(3 * day)], tables, 1, registry, days=2)
    _take(spark, [event(day, frame=1), event(0, frame=2)], tables, 2, registry, days=2)
    assert {r.window_start.date() for r in late.read_late_metrics(spark, tables).collect()} == {at(day).date(), at(3 * day).date()}


def test_j2_as_a_stream(spark, tmp_path):
    registry = cameras(spark, ("a", 1.0, 2.0, "A"))
    batches = _arrivals(3, 3)
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/in").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    late.stream_late_windows(stream, registry, f"{tmp_path}/t", f"{tmp_path}/c", 9, None, 5, SCORING).awaitTermination()
    want = window_metrics(events(spark, sum(batches, [])), 5, SCORING)
    assert _same(late.read_late_metrics(spark, f"{tmp_path}/t"), want)
    assert _same(late.read_late_alerts(spark, f"{tmp_path}/t"), alerts_from_metrics(want, registry))
