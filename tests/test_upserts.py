"""B2: versions of the upserted table, seen by readers, compaction, replays and a vacuum."""

import random

import pytest
from pyspark.sql import functions as F

from roadpulse.operators.maintenance import upsert_metrics
from roadpulse.plans.journal import Journal, Store
from roadpulse.streaming import upserts as sup
from tests.data import at, metric, metrics

DAY = 17_280


def _rows(df):
    return sorted((r.camera_id, str(r.window_start), str(r.lane_id), r.vehicle_count) for r in df.collect())


def _stream(spark, folder):
    return spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)


def test_b2_the_newest_batch_wins_and_filters_reach_the_scan(spark, tmp_path):
    first, second = [metric(n=0, count=1), metric(n=1, lane=1, count=2)], [metric(n=0, count=9)]
    table = f"{tmp_path}/table"
    for rows in (first, second):
        metrics(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sup.upsert_stream(_stream(spark, f"{tmp_path}/in"), table, f"{tmp_path}/c", every=None).awaitTermination()
    want = _rows(upsert_metrics(metrics(spark, first), metrics(spark, second)))
    assert _rows(sup.read_upserted(spark, table)) == want
    found = sup.read_upserted(spark, table).filter("date = DATE '2026-04-16' AND camera_id = 'cam_01'")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(date" in plan and "EqualTo(camera_id,cam_01)" in plan
    assert sup.compact_upserts(spark, table, at(0).date()) == 0
    assert sup.compact_upserts(spark, table, at(86_400).date()) == 1
    assert _rows(sup.read_upserted(spark, table)) == want and _rows(sup.read_upserted(spark, table, 1)) == _rows(metrics(spark, first))
    assert sup.compact_upserts(spark, table, at(86_400).date()) == 0


def test_b2_a_replay_after_compaction_and_a_reader_during_it(spark, tmp_path):
    """Three days, five batches; every batch is replayed before and after a fold, and readers keep their version."""
    rng = random.Random(3)
    table, state, batches = f"{tmp_path}/table", {}, []
    for n in range(5):
        rows = {(c, d): metric(c, d * DAY, count=100 * n + d) for c in "abc" for d in (0, 1, 2) if rng.random() < 0.7}
        batches.append(list(rows.values()))
        sup.log_batch(metrics(spark, batches[-1]), table, n)
        state |= rows
    want = _rows(metrics(spark, list(state.values())))
    reader = sup.read_upserted(spark, table)
    assert sup.compact_upserts(spark, table, at(2 * 86_400).date()) > 0
    assert _rows(reader) == want and _rows(sup.read_upserted(spark, table)) == want
    for n in (0, 2, 4):
        sup.log_batch(metrics(spark, batches[n]), table, n)
        assert _rows(sup.read_upserted(spark, table)) == want
    sup.log_batch(metrics(spark, [metric("a", 0, count=7)]), table, 5)  # a later batch still wins over the fold
    assert ("a", str(at(0).replace(tzinfo=None)), "None", 7) in _rows(sup.read_upserted(spark, table))
    sup.compact_upserts(spark, table, at(9 * 86_400).date())
    assert _rows(reader) == want and len(_rows(sup.read_upserted(spark, table))) == len(want)


def test_b2_two_writers_and_a_stopped_compaction(spark, tmp_path, monkeypatch):
    table, put = f"{tmp_path}/table", Journal.put
    for n in range(2):
        sup.log_batch(metrics(spark, [metric("a", 0, count=n)]), table, n)

    def late(self, name, value=None):  # another writer commits first
        monkeypatch.undo()
        sup.log_batch(metrics(spark, [metric("a", 0, count=5), metric("b", 0, count=6)]), table, 2)
        return put(self, name, value)

    monkeypatch.setattr(Journal, "put", late)
    assert sup.compact_upserts(spark, table, at(86_400).date()) == 1
    assert [r[3] for r in _rows(sup.read_upserted(spark, table))] == [5, 6]

    def stopped(self, name, value=None):
        raise InterruptedError

    monkeypatch.setattr(Journal, "put", stopped)
    with pytest.raises(InterruptedError):
        sup.compact_upserts(spark, table, at(86_400).date())
    monkeypatch.undo()
    assert [r[3] for r in _rows(sup.read_upserted(spark, table))] == [5, 6]
    assert sup.compact_upserts(spark, table, at(86_400).date()) == 1


def test_b2_vacuum(spark, tmp_path):
    table = f"{tmp_path}/table"
    for n in range(4):
        sup.log_batch(metrics(spark, [metric("a", 0, count=n)]), table, n)
    sup.compact_upserts(spark, table, at(86_400).date())
    assert sup.vacuum_upserts(spark, table, 2) == 0  # all are young
    assert sup.vacuum_upserts(spark, table, 1, older_than_seconds=-1) == 4
    assert [r[3] for r in _rows(sup.read_upserted(spark, table))] == [3]
    assert len(Store(spark).names(f"{table}/data")) == 1 and len(Journal(spark, f"{table}/manifest").names()) == 1


def test_b2_empty_table_and_batch(spark, tmp_path):
    table = f"{tmp_path}/table"
    sup.log_batch(metrics(spark, []), table, 0)
    assert sup.read_upserted(spark, table).count() == 0 and sup.compact_upserts(spark, table, at(0).date()) == 0
    assert sup.read_upserted(spark, table).schema["date"].dataType.simpleString() == "date"
    sup.log_batch(metrics(spark, [metric()]).withColumn("date", F.lit("x")), table, 1)
    assert sup.read_upserted(spark, table).count() == 1
