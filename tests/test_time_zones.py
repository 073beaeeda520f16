"""Times without a zone are UTC wherever the driver runs."""

import json
import os
import subprocess
import sys

import pytest

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import json, sys
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate())
spark.sparkContext.setLogLevel("OFF")
from roadpulse.catalog import QUERIES
out = {}
for name in ("range_summary", "metrics_history", "retention_counts", "stream_alerts"):
    rows = [json.loads(x) for x in QUERIES[name](spark, sys.argv[1]).toJSON().collect()]
    out[name] = sorted(json.dumps(r, sort_keys=True) for r in rows)
# Two sightings in two batches, in the hour that New York's clocks skip.
from datetime import datetime, timezone
from roadpulse.schemas import RAW_EVENT
from roadpulse.streaming import sinks, speed
for n in (0, 5):
    seen = {"camera_id": "a", "vehicle_id": "v", "ts": datetime(2024, 3, 10, 2, 30, n, tzinfo=timezone.utc), "frame_id": n, "centroid_x": 20.0 * n, "centroid_y": 0.0}
    row = tuple(seen.get(f.name) for f in RAW_EVENT)
    spark.createDataFrame([row], RAW_EVENT).coalesce(1).write.mode("append").parquet(sys.argv[2] + "/in")
stream = spark.readStream.schema(RAW_EVENT).option("maxFilesPerTrigger", 1).parquet(sys.argv[2] + "/in")
sinks.write_raw(speed.stream_fill_speed(stream), sys.argv[2] + "/t", sys.argv[2] + "/c", every=None).awaitTermination()
out["clocks"] = sorted(spark.read.parquet(sys.argv[2] + "/t").selectExpr("unix_micros(ts) AS at", "speed_kmh").toJSON().collect())
print("RESULT" + json.dumps(out))
"""


def _run(zone, folder):
    env = os.environ | {"TZ": zone, "PYTHONPATH": ROOT}
    done = subprocess.run([sys.executable, "-c", SCRIPT, SF, folder], env=env, cwd=ROOT, capture_output=True, text=True, timeout=600)
    assert "RESULT" in done.stdout, done.stderr[-2000:]
    return json.loads(done.stdout.split("RESULT")[1])


def test_results_do_not_depend_on_the_drivers_zone(tmp_path):
    utc = _run("UTC", str(tmp_path / "a"))
    assert all(utc.values()) and '"speed_kmh":3.6' in utc["clocks"][1].replace("00000000000005", "")
    for n, zone in enumerate(("America/New_York", "Asia/Kolkata")):
        assert _run(zone, str(tmp_path / f"z{n}")) == utc
