"""The retention job, stopped at every step and run again."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from roadpulse.operators import retention as rt
from roadpulse.plans.journal import Journal, Store
from roadpulse.streaming import sinks as ssk
from tests.data import at, event, events, metric, metrics

DAY = 17_280  # windows of five seconds
DAYS = [0, -1, -29.9, -30, -30.4, -45]


class Stopped(Exception):
    pass


def _tables(spark, folder):
    rows = metrics(spark, [metric("a", int(DAY * d), lane=lane) for d in DAYS for lane in (None, 1)])
    seen = events(spark, [event(3600 * h, frame=int(10 * h)) for h in (-48, -24.5, -23.9, -23, 0)])
    for name, df, column in (("m", rows, "window_start"), ("e", seen, "ts")):
        df.withColumn("date", F.to_date(column)).coalesce(1).write.partitionBy("date").parquet(f"{folder}/{name}")
    return [f"{folder}/{x}" for x in ("e", "m", "archive")]


def _where(spark, paths):
    """Every metric and event row, and how often it is in the tables and in the archive."""
    out = Counter()
    for r in spark.read.parquet(paths[1]).collect():
        out["table", r.lane_id, r.window_start] += 1
    for r in spark.read.parquet(paths[0]).collect():
        out["event", None, r.ts] += 1
    if any(n.endswith("archived") for n in Journal(spark, paths[2] + "_log").names()):
        for r in rt.read_archive(spark, paths[2]).collect():
            out["archive", r.lane_id, r.window_start] += 1
    return out


def test_k1_archives_first_and_drops_what_has_expired(spark, tmp_path):
    paths = _tables(spark, tmp_path)
    assert rt.retention_job(spark, *paths, at(0)) == (2, 4)
    assert rt.read_archive(spark, paths[2]).count() == 4
    assert (spark.read.parquet(paths[0]).count(), spark.read.parquet(paths[1]).count()) == (3, 8)
    assert rt.retention_job(spark, *paths, at(0)) == (0, 0) and rt.read_archive(spark, paths[2]).count() == 4
    assert "date=2026-03-02" not in Store(spark).names(paths[1])  # emptied folders go
    assert rt.read_archive(spark, paths[2]).select("camera_id", "date").distinct().count() == 2


STOPS = [("plan", True), ("archived", False), ("archived", True), ("kept", False), ("staged", False), ("dropped", False), ("dropped", True), ("done", False)]


@pytest.mark.parametrize(("step", "noted"), STOPS)
def test_k1_stopped_at_a_step_and_run_again_later(spark, tmp_path, monkeypatch, step, noted):
    """Stopped just before or after a step is noted, then run with a later ``as_of``: as if it had run undisturbed."""
    paths, calm = _tables(spark, tmp_path / "x"), _tables(spark, tmp_path / "y")
    put = Journal.put

    def stopping(self, name, value=None):
        if name.endswith(step) and not noted:
            raise Stopped
        made = put(self, name, value)
        if name.endswith(step):
            raise Stopped
        return made

    monkeypatch.setattr(Journal, "put", stopping)
    with pytest.raises(Stopped):
        rt.retention_job(spark, *paths, at(0))
    monkeypatch.undo()
    late = metrics(spark, [metric("b", int(DAY * -30.2))])  # arrives between the runs, on the border date
    for p in (paths, calm):
        if p is calm:
            rt.retention_job(spark, *calm, at(0))
        late.withColumn("date", F.to_date("window_start")).write.mode("append").partitionBy("date").parquet(p[1])
        rt.retention_job(spark, *p, at(43_200))
    got = _where(spark, paths)
    assert got == _where(spark, calm) and set(got.values()) == {1}
    assert sum(n for (place, *_), n in got.items() if place != "event") == 2 * len(DAYS) + 1


@pytest.mark.parametrize(("method", "call"), [("rename", 1), ("delete", 4), ("rename", 4)])
def test_k1_stopped_within_a_step(spark, tmp_path, monkeypatch, method, call):
    """Stopped between two file operations of a step, twice in a row at the same place."""
    paths, calm = _tables(spark, tmp_path / "x"), _tables(spark, tmp_path / "y")
    real, calls = getattr(Store, method), [0]

    def stopping(self, *args):
        if not any("_log/." in str(a) for a in args):
            calls[0] += 1
            if calls[0] == call:
                raise Stopped
        return real(self, *args)

    for _ in range(2):
        calls[0] = 0
        monkeypatch.setattr(Store, method, stopping)
        try:
            rt.retention_job(spark, *paths, at(0))
        except Stopped:
            pass
        monkeypatch.undo()
    rt.retention_job(spark, *paths, at(86_400))
    for as_of in (0, 86_400):
        rt.retention_job(spark, *calm, at(as_of))
    assert _where(spark, paths) == _where(spark, calm) and set(_where(spark, paths).values()) == {1}


def test_k1_on_a_table_that_a_stream_has_written(spark, tmp_path):
    rows = [event(3600 * h, frame=int(10 * h)) for h in (-60, -48, -24.5, -23.9, -23, 0)]
    for n in range(0, 6, 2):
        events(spark, rows[n : n + 2]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events(spark, []).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    ssk.write_raw(stream, f"{tmp_path}/e", f"{tmp_path}/c", every=None, dated_by="ts").awaitTermination()
    metrics(spark, [metric()]).withColumn("date", F.to_date("window_start")).write.partitionBy("date").parquet(f"{tmp_path}/m")
    assert rt.retention_job(spark, f"{tmp_path}/e", f"{tmp_path}/m", f"{tmp_path}/a", at(0)) == (3, 0)
    assert sorted(r.frame_id for r in spark.read.parquet(f"{tmp_path}/e").collect()) == [-239, -230, 0]
    ssk.write_raw(stream, f"{tmp_path}/listed", f"{tmp_path}/c2", every=None).awaitTermination()
    with pytest.raises(ValueError, match="list of its files"):
        rt.retention_job(spark, f"{tmp_path}/listed", f"{tmp_path}/m", f"{tmp_path}/a", at(0))


def test_k1_leaves_an_empty_table_and_runs_on(spark, tmp_path):
    paths = _tables(spark, tmp_path)
    assert rt.retention_job(spark, *paths, at(100 * 86_400)) == (5, 12)
    assert Store(spark).files(paths[0]) == Store(spark).files(paths[1]) == []
    assert rt.retention_job(spark, *paths, at(101 * 86_400)) == (0, 0) and rt.read_archive(spark, paths[2]).count() == 12


def test_notes_are_made_once(spark, tmp_path):
    log = Journal(spark, f"{tmp_path}/log")
    assert log.names() == [] and log.put("a", {"x": [1, "é"]}) and not log.put("a", 2)
    assert log.get("a") == {"x": [1, "é"]} and log.names() == ["a"]
