"""A declared lane topology as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.schemas import CROSS_EDGE, LANE


def topology_tables(spark: SparkSession, spec: dict) -> tuple[DataFrame, DataFrame]:
    """``{"cameras": [{"camera_id", "lane_ids"}], "cross_camera_edges": [{"from_camera", ...}]}`` as lanes and links."""
    cameras = [(c["camera_id"], i, c["lane_ids"]) for i, c in enumerate(spec["cameras"])]
    declared = spark.createDataFrame(cameras, "camera_id STRING, camera_pos BIGINT, lane_ids ARRAY<INT>")
    lanes = declared.select("camera_id", "camera_pos", F.posexplode("lane_ids").alias("lane_pos", "lane_id")).select(
        "camera_id", "camera_pos", "lane_id", F.col("lane_pos").cast("long").alias("lane_pos")
    )
    links = [tuple(e[f.name] for f in CROSS_EDGE) for e in spec.get("cross_camera_edges", [])]
    return lanes.to(LANE), spark.createDataFrame(links, CROSS_EDGE)
