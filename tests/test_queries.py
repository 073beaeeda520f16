"""Registered queries against SQL on the given tables, where these are present."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from roadpulse.sources import tables as tb
from tests.oracle_check import compare, connect

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
QUICK = (
    "validate_events", "reject_reasons", "speed_fallback", "window_metrics_lane", "latest_per_lane", "top_segments",
    "compare_ranges", "dashboard_summary", "heatmap", "alerts_from_metrics", "ack_results", "upsert_metrics",
    "camera_changes", "audit_rows", "gap_fill", "dense_signal", "trend", "congestion_episodes", "khop_neighbours",
    "sensor_import", "stream_window_metrics",
)


@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    assert compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_properties_are_parsed_once(spark):
    """Neither filters nor fields derived from the number in the properties may parse them again."""
    plan = tb.raw_events(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("get_json_object") == 1


def test_lane_graph_reads_the_detections_once(spark, monkeypatch):
    """Nodes and edges come from one table of lanes, and the signal's metrics are the other use of the detections."""
    seen = spark.sparkContext.accumulator(0)
    found = tb.event_lanes(spark, SF).cache()

    def counted(camera):
        seen.add(1)
        return camera

    def lanes(spark, sf):
        return found.withColumn("camera_id", F.udf(counted, "string").asNondeterministic()("camera_id"))

    monkeypatch.setattr(tb, "event_lanes", lanes)
    number = found.count()
    assert entry.queries()["neighbour_means"](spark, SF).count() > 0
    assert seen.value == number
    found.unpersist()
