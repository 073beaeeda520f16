"""The given tables in the shapes of the traffic model.

``events`` are camera detections (a third of them from ``cam_0``), ``nation`` and ``region`` the camera registry,
``lineitem`` and ``supplier`` a large detection table, sensor readings and a lane topology that grow with the data.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.config import VEHICLE_CLASSES
from roadpulse.functions.rules import plus_seconds


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _stream_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    schema = read_table(spark, sf_dir, name).schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)


def _detection_fields(k: Column) -> dict[str, Column]:
    event_type = F.col("event_type")
    return {
        "camera_id": F.when(k % 3 == 0, "cam_0").otherwise(F.concat(F.lit("cam_"), F.col("user_id") % 32)),
        "timestamp": F.col("ts").cast("timestamp"),
        "frame_id": F.col("event_id"),
        "vehicle_id": F.concat(F.lit("veh_"), "user_id"),
        "class": F.when(event_type == "click", "car")
        .when(event_type == "view", "bus")
        .when(event_type == "purchase", "truck")
        .when(event_type == "signup", "motorcycle")
        .otherwise("unknown"),
        "confidence": F.when(k == 99, 1.4).otherwise(F.lit(0.5) + k / 200.0),
        "bbox": F.struct(
            (F.col("event_id") * 7 % 1900 / 4.0).alias("x"),
            (F.col("event_id") * 11 % 1000 / 4.0).alias("y"),
            (k + 80).cast("double").alias("w"),
            (k + 40.5).alias("h"),
        ),
        "centroid": F.struct(
            (F.col("event_id") * 37 % 1920).cast("double").alias("x"),
            (F.col("event_id") * 53 % 1080).cast("double").alias("y"),
        ),
        "lane_id": F.when(k % 5 != 0, (k % 3 + 1).cast("int")),
        "speed_estimate": F.when(k % 7 != 0, F.col("value") / 5),
    }


def _k() -> Column:
    return F.get_json_object("props", "$.k").cast("int")


def _with_k(events: DataFrame) -> DataFrame:
    """Add the number in the properties. It leaves through a generator, so that no filter on what follows from it is pushed
    below, where the optimizer would parse the properties again for every use."""
    return events.select("*", F.explode(F.array(_k())).alias("_k"))


def detections(events: DataFrame) -> DataFrame:
    """Typed detections, including those that validation refuses."""
    fields = _detection_fields(F.col("_k"))
    return _with_k(events).select(*[expr.alias(name) for name, expr in fields.items()])


def detection_messages(events: DataFrame) -> DataFrame:
    """Detections as JSON text. Some are cut off, wrapped in a list, or carry a frame number that is no number."""
    k = _k()
    text = F.to_json(F.struct(*[expr.alias(name) for name, expr in _detection_fields(k).items()]))
    value = (
        F.when(k == 96, F.concat(F.lit("["), text, F.lit("]")))
        .when(k == 97, F.regexp_replace(text, '"frame_id":[0-9]+', '"frame_id":"NaN"'))
        .when(k == 98, F.substring(text, 1, 40))
        .otherwise(text)
    )
    return events.select(value.alias("value"))


def _accepted(df: DataFrame) -> DataFrame:
    return df.filter(F.col("class").isin(*VEHICLE_CLASSES) & F.col("confidence").between(0.0, 1.0))


def raw_events(
    spark: SparkSession,
    sf_dir: str,
    start: datetime | None = None,
    end: datetime | None = None,
    stream: bool = False,
) -> DataFrame:
    """Accepted detections in the raw-event shape, optionally of ``[start, end)``; the bounds reach the file scan."""
    from roadpulse.operators.projections import flatten_event

    events = _stream_table(spark, sf_dir, "events") if stream else read_table(spark, sf_dir, "events")
    # Bounds as text: a datetime literal would pass through the zone of the driver.
    if start is not None:
        events = events.filter(F.col("ts") >= F.lit(start.isoformat(" ")).cast("timestamp_ntz"))
    if end is not None:
        events = events.filter(F.col("ts") < F.lit(end.isoformat(" ")).cast("timestamp_ntz"))
    return flatten_event(_accepted(detections(events)))


def camera_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cameras 0-24; camera 6 has no place, camera 7 no segment; cameras from 25 on are not registered."""
    nation, region = read_table(spark, sf_dir, "nation"), read_table(spark, sf_dir, "region")
    key = F.col("n_nationkey")
    return nation.join(region, nation["n_regionkey"] == region["r_regionkey"], "left").select(
        F.concat(F.lit("cam_"), key).alias("camera_id"),
        F.col("n_name").alias("name"),
        F.when(key != 6, key * 5.5 - 60).alias("latitude"),
        F.when(key != 6, key * 11.25 - 120).alias("longitude"),
        F.when(key != 7, F.col("r_name")).alias("road_segment"),
        F.lit(None).cast("string").alias("description"),
    )


def volume_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as raw events: one camera per supplier, one lane per line number, one vehicle per part."""
    flag = F.col("l_returnflag")
    return read_table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("cam_"), "l_suppkey").alias("camera_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.concat(F.lit("veh_"), "l_partkey").alias("vehicle_id"),
        F.when(flag == "A", "car").when(flag == "N", "bus").otherwise("truck").alias("vehicle_class"),
        F.col("l_quantity").alias("speed_kmh"),
        F.col("l_linenumber").alias("lane_id"),
    )


def sensor_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as loop-detector readings."""
    return read_table(spark, sf_dir, "lineitem").select(
        F.col("l_shipdate").cast("timestamp").alias("t"),
        (F.col("l_suppkey") * 10 + F.col("l_linenumber")).alias("sensor_id"),
        (F.col("l_extendedprice") / 100).alias("flow"),
        (F.col("l_discount") * 8).alias("occupancy"),
        (F.col("l_quantity") * 2).alias("speed"),
    )


def sensor_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes 1-4 of every supplier's camera; the detectors of lanes 5-7 stay unmapped."""
    suppliers = read_table(spark, sf_dir, "supplier").withColumn("lane_id", F.explode(F.array(*map(F.lit, range(1, 5)))))
    return suppliers.select(
        (F.col("s_suppkey") * 10 + F.col("lane_id")).alias("sensor_id"),
        F.concat(F.lit("cam_"), "s_suppkey").alias("camera_id"),
        "lane_id",
    )


def sensor_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent detectors: the next lane of the same camera, and the same lane of the next camera."""
    sensor = F.col("l_suppkey") * 10 + F.col("l_linenumber")
    pairs = read_table(spark, sf_dir, "lineitem").select(
        sensor.alias("from"), F.explode(F.array(sensor + 1, sensor + 10)).alias("to")
    )
    return pairs.distinct().withColumn("cost", F.lit(1.0))


def lane_topology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes seen in the line items, in order."""
    lanes = read_table(spark, sf_dir, "lineitem").select("l_suppkey", "l_linenumber").distinct()
    return lanes.select(
        F.concat(F.lit("cam_"), "l_suppkey").alias("camera_id"),
        F.col("l_suppkey").alias("camera_pos"),
        F.col("l_linenumber").alias("lane_id"),
        F.col("l_linenumber").cast("long").alias("lane_pos"),
    )


def cross_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each camera leads into lane 1 of the next one; the last link ends outside the graph."""
    key = F.col("s_suppkey")
    return read_table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("cam_"), key).alias("from_camera"),
        (key % 7 + 1).cast("int").alias("from_lane"),
        F.concat(F.lit("cam_"), key + 1).alias("to_camera"),
        F.lit(1).alias("to_lane"),
    )


def event_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lanes seen in the detections, cameras in numeric order."""
    lanes = raw_events(spark, sf_dir).filter(F.col("lane_id").isNotNull()).select("camera_id", "lane_id").distinct()
    return lanes.select(
        "camera_id",
        F.substring_index("camera_id", "_", -1).cast("long").alias("camera_pos"),
        "lane_id",
        F.col("lane_id").cast("long").alias("lane_pos"),
    )


def camera_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as changes to the camera registry: creates, partial updates and deletes of cameras 0-39.

    Some name no camera, some have no place in the order, some clear the road segment.
    """
    key = F.col("o_orderkey")
    price = F.col("o_totalprice")
    return read_table(spark, sf_dir, "orders").select(
        F.when(key % 101 != 0, key).alias("seq"),
        F.concat(F.lit("admin_"), F.col("o_custkey") % 5).alias("actor"),
        F.when(key % 7 == 0, "create").when(key % 7 == 1, "delete").otherwise("update").alias("action"),
        F.when(key % 97 != 0, F.concat(F.lit("cam_"), F.col("o_custkey") % 40)).alias("camera_id"),
        F.when(key % 4 == 0, F.concat(F.lit("name_"), key)).alias("name"),
        F.when(key % 2 == 0, F.floor(price / 5000) - 5).cast("double").alias("latitude"),
        F.when(key % 2 == 0, F.floor(price / 2500) - 20).cast("double").alias("longitude"),
        F.when(key % 3 == 0, F.col("o_orderpriority")).alias("road_segment"),
        F.lit(None).cast("string").alias("description"),
        F.when(key % 12 == 1, F.array(F.lit("road_segment"))).alias("cleared"),
        F.col("o_orderdate").cast("timestamp").alias("changed_at"),
    )


def acknowledgements(alerts: DataFrame) -> DataFrame:
    """Two requests per alert that lasted several windows, one for an alert that never was, and one without an id."""
    stamp = F.unix_seconds("triggered_at")
    known = alerts.select(
        "alert_id", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("n"), stamp.alias("stamp"), "camera_id"
    ).filter((F.col("n") >= 3) | (F.col("stamp") / 21600 % 3 != 0))
    return known.select(
        (F.col("stamp") * 1000 + F.substring_index("camera_id", "_", -1).cast("long") * 10 + F.col("n")).alias("ack_id"),
        F.when(F.col("n") == 3, F.concat("alert_id", F.lit("#"))).when(F.col("n") < 3, F.col("alert_id")).alias("alert_id"),
        F.concat(F.lit("admin_"), "n").alias("admin_id"),
        plus_seconds(F.timestamp_seconds("stamp"), 600 * (F.lit(4) - F.col("n"))).alias("acknowledged_at"),
    )
