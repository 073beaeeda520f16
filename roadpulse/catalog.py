"""The registered queries: every operator over the given tables.

Windows of six hours give the month of detections several rows per window. Times come out without a zone, maps and
arrays as JSON text, so that results compare with SQL on the same tables.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.config import Episode, ForecastWindow, Retention, Scoring, SpeedFallback
from roadpulse.functions.rules import plus_seconds, round_stable
from roadpulse.operators import (
    alerts as al,
    analytics as an,
    dashboard as db,
    episodes as ep,
    features as ft,
    forecast_ml as ml,
    gapfill as gf,
    graph as gr,
    latest as lt,
    maintenance as mt,
    projections as pj,
    quality as ql,
    retention as rt,
    rollups as ru,
    sketches as sk,
    speed as sp,
    trend as tr,
    windows as wn,
)
from roadpulse.plans.slices import MICROS, slice_start
from roadpulse.session import prepare, shared_folder
from roadpulse.sources import detections as dt
from roadpulse.sources import sensors as sn
from roadpulse.sources import tables as tb
from roadpulse.streaming import alerts as sal
from roadpulse.streaming import events as sev
from roadpulse.streaming import ingest as sin
from roadpulse.streaming import late as slt
from roadpulse.streaming import metrics as smt
from roadpulse.streaming import sinks as ssk
from roadpulse.streaming import speed as ssp
from roadpulse.streaming import upserts as sup

WINDOW = 6 * 3600
DAY = 86_400
SLICE = 5 * DAY
SCORING = Scoring(max_vehicle_count=25.0)
SPEED = SpeedFallback(ttl_seconds=6 * 3600)
CALIBRATION = {"cam_0": 0.10, "cam_1": 0.02}
RANGE_A = (datetime(2024, 1, 2), datetime(2024, 1, 10))
RANGE_B = (datetime(2024, 1, 8), datetime(2024, 1, 20))
EPISODE = Episode(start_threshold=0.45, end_threshold=0.40, min_steps=2, step_seconds=3600)
ARRIVALS = [datetime(2024, 1, day) for day in (1, 7, 13, 19, 25)]
SHAPE = ForecastWindow(step_seconds=WINDOW, vehicle_count_max=25.0, speed_max_kmh=60.0)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register a query under its name; its times lose their zone."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plain_times(fn(prepare(spark), sf_dir))

    QUERIES[fn.__name__] = run
    return fn


def plain_times(df: DataFrame) -> DataFrame:
    zoned = [f.name for f in df.schema if isinstance(f.dataType, T.TimestampType)]
    return df.withColumns({name: F.col(name).cast("timestamp_ntz") for name in zoned}) if zoned else df


def _metrics(spark, sf, start=None, end=None, seconds=WINDOW) -> DataFrame:
    return wn.window_metrics(tb.raw_events(spark, sf, start, end), seconds, SCORING)


def _stored(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table that a query reads several times to the shared folder, and read it from there."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def _metrics_table(spark, sf) -> DataFrame:
    """Metrics as the stored table they are in operation, computed once however often a query reads them."""
    return _stored(_metrics(spark, sf), "metrics")


def _metrics_between(spark, sf, start, end) -> DataFrame:
    """Metrics whose windows start in ``[start, end]``, from the detections of these windows only."""
    return _metrics(spark, sf, start, end + timedelta(seconds=WINDOW))


def _as_of(spark, sf) -> Column:
    """End of the newest window. It follows from the newest detection, so no window has to be computed for it."""
    newest = F.unix_micros(F.max("ts"))
    end = F.timestamp_micros(slice_start(newest, WINDOW * MICROS) + F.lit(WINDOW * MICROS))
    return tb.raw_events(spark, sf).agg(end.alias("as_of")).scalar()


def _alerts(spark, sf, metrics: DataFrame | None = None) -> DataFrame:
    metrics = _metrics_table(spark, sf) if metrics is None else metrics
    return al.alerts_from_metrics(metrics, tb.camera_registry(spark, sf), SLICE)


def _acked(spark, sf) -> DataFrame:
    alerts = _stored(_alerts(spark, sf), "alerts")
    return al.acknowledge(alerts, tb.acknowledgements(alerts))


def _text(df: DataFrame) -> DataFrame:
    return df.withColumn("counts_by_class", F.to_json("counts_by_class"))


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: round_stable(F.col(c), 6) for c in columns})


# --- ingest --------------------------------------------------------------------------------------------------------


def _messages(spark, sf) -> DataFrame:
    return tb.detection_messages(tb.read_table(spark, sf, "events"))


@query
def validate_events(spark, sf):
    valid, _ = dt.parse_detections(_messages(spark, sf))
    return valid.select("*", "bbox.*", F.col("centroid.x").alias("cx"), F.col("centroid.y").alias("cy")).drop(
        "bbox", "centroid"
    )


@query
def reject_reasons(spark, sf):
    _, rejected = dt.parse_detections(_messages(spark, sf))
    return dt.reject_reasons(rejected)


@query
def flatten_events(spark, sf):
    return tb.raw_events(spark, sf)


@query
def speed_fallback(spark, sf):
    filled = sp.fill_speed(tb.raw_events(spark, sf), CALIBRATION, SPEED)
    return _rounded(filled.select("frame_id", "camera_id", "vehicle_id", "ts", "speed_kmh"), "speed_kmh")


# --- windows and current state -------------------------------------------------------------------------------------


@query
def window_metrics_camera(spark, sf):
    return _text(pj.camera_wide(_metrics(spark, sf)))


@query
def window_metrics_lane(spark, sf):
    return _text(pj.lane_level(_metrics(spark, sf)))


@query
def volume_window_metrics(spark, sf):
    return _text(wn.window_metrics(tb.volume_events(spark, sf), DAY, SCORING))


@query
def window_metrics_filled(spark, sf):
    """Windows over detections whose missing speeds were filled: the whole batch path in one plan."""
    filled = sp.fill_speed(tb.raw_events(spark, sf), CALIBRATION, SPEED)
    return _text(wn.window_metrics(filled, WINDOW, SCORING))


@query
def latest_per_camera(spark, sf):
    return _text(lt.latest_per_camera(_metrics(spark, sf)))


@query
def latest_per_lane(spark, sf):
    return _text(lt.latest_per_lane(_metrics(spark, sf)))


@query
def current_metrics(spark, sf):
    metrics = _metrics(spark, sf)
    seen, unseen = (lt.current_metrics(metrics, camera) for camera in ("cam_0", "cam_none"))
    return _text(seen.unionByName(unseen))


@query
def list_cameras(spark, sf):
    return lt.list_cameras(_metrics(spark, sf))


@query
def metrics_history(spark, sf):
    return _text(lt.metrics_history(_metrics_between(spark, sf, *RANGE_A), "cam_0", *RANGE_A))


@query
def lane_scan(spark, sf):
    return lt.scan_lane_metrics(_metrics_between(spark, sf, *RANGE_A), *RANGE_A)


@query
def recent_events(spark, sf):
    return lt.recent_events(tb.raw_events(spark, sf), 25)


@query
def metrics_with_segment(spark, sf):
    return an.with_segment(_metrics(spark, sf), tb.camera_registry(spark, sf)).select(
        "camera_id", "lane_id", "window_start", "congestion_score", "segment_key"
    )


# --- analytics -----------------------------------------------------------------------------------------------------


@query
def range_summary(spark, sf):
    summary = an.range_summary(_metrics_between(spark, sf, *RANGE_A), *RANGE_A)
    return _rounded(summary, "average_congestion", "average_speed_kmh")


@query
def last_day_summary(spark, sf):
    summary = an.range_summary(_metrics(spark, sf), None, None, as_of=_as_of(spark, sf))
    return _rounded(summary, "average_congestion", "average_speed_kmh")


@query
def peak_hour(spark, sf):
    return an.peak_hour(_metrics_between(spark, sf, *RANGE_B), *RANGE_B)


@query
def incident_summary(spark, sf):
    return _rounded(an.incident_summary(_metrics_between(spark, sf, *RANGE_A), *RANGE_A), "average_congestion")


@query
def hourly_trends(spark, sf):
    trends = an.hourly_trends(_metrics_between(spark, sf, *RANGE_A), *RANGE_A)
    return _rounded(trends, "average_congestion", "average_speed_kmh")


@query
def top_segments(spark, sf):
    top = an.top_segments(_metrics_between(spark, sf, *RANGE_B), tb.camera_registry(spark, sf), *RANGE_B)
    return _rounded(top, "average_congestion", "average_queue_length")


@query
def compare_ranges(spark, sf):
    both = an.compare_ranges(_metrics_between(spark, sf, RANGE_A[0], RANGE_B[1]), RANGE_A, RANGE_B)
    floats = [f.name for f in both.schema if isinstance(f.dataType, T.DoubleType)]
    return _rounded(both, *floats)


@query
def dashboard_summary(spark, sf):
    metrics = _metrics_table(spark, sf)
    figures = db.dashboard_summary(metrics, _alerts(spark, sf, metrics), _as_of(spark, sf), minutes=1440)
    return figures.withColumn("congestion_breakdown", F.to_json("congestion_breakdown")).select(
        "*", F.col("worst_camera.camera_id").alias("worst"), F.col("worst_camera.congestion_level").alias("worst_level")
    ).drop("worst_camera")


@query
def level_breakdown(spark, sf):
    return db.level_breakdown(_metrics(spark, sf))


@query
def worst_camera(spark, sf):
    return db.worst_camera(_metrics(spark, sf))


@query
def heatmap(spark, sf):
    return db.heatmap(_metrics(spark, sf), tb.camera_registry(spark, sf), _as_of(spark, sf), minutes=1440)


@query
def heat_snapshot(spark, sf):
    return db.heat_snapshot(_metrics(spark, sf), _as_of(spark, sf), minutes=1440)


@query
def incidents(spark, sf):
    return _text(db.incidents(_metrics(spark, sf), tb.camera_registry(spark, sf)))


@query
def incidents_moderate(spark, sf):
    return _text(db.incidents(_metrics(spark, sf), tb.camera_registry(spark, sf), "MODERATE"))


# --- alerts --------------------------------------------------------------------------------------------------------


@query
def alerts_from_metrics(spark, sf):
    return _alerts(spark, sf)


@query
def alert_history(spark, sf):
    return al.alert_history(
        _acked(spark, sf), start=RANGE_A[0], end=RANGE_B[1], severity="warning", alert_type="congestion"
    )


@query
def unacknowledged_alerts(spark, sf):
    return al.unacknowledged(_acked(spark, sf))


@query
def unresolved_alerts(spark, sf):
    return al.unresolved(_alerts(spark, sf))


@query
def acknowledge_alerts(spark, sf):
    return _acked(spark, sf)


@query
def ack_results(spark, sf):
    alerts = _stored(_alerts(spark, sf), "alerts")
    return al.ack_results(alerts, tb.acknowledgements(alerts))


@query
def new_alerts(spark, sf):
    return al.new_alerts(_metrics(spark, sf))


@query
def alert_export(spark, sf):
    return al.alert_export(_acked(spark, sf))


# --- maintenance ---------------------------------------------------------------------------------------------------


def _threshold_table(spark, sf) -> DataFrame:
    key = F.col("r_regionkey")
    return tb.read_table(spark, sf, "region").select(
        (key + 1).alias("id"), (key * 0.01 + 0.25).alias("low"), (key * 0.01 + 0.4).alias("moderate"),
        (key * 0.01 + 0.6).alias("high"),
    )


@query
def reclassify_thresholds(spark, sf):
    levels = mt.reclassify(_metrics(spark, sf), _threshold_table(spark, sf), SCORING)
    return levels.select("camera_id", "lane_id", "window_start", "congestion_level", "congestion_score")


def _sweep(spark, sf):
    retention = Retention(events_hours=240, metrics_days=20)
    return mt.sweep(tb.raw_events(spark, sf), _metrics(spark, sf), _as_of(spark, sf), retention)


@query
def retention_kept(spark, sf):
    parts = _sweep(spark, sf)
    events = parts["events_kept"].select(F.lit("event").alias("kind"), "camera_id", F.col("ts").alias("at"), "lane_id")
    metrics = parts["metrics_kept"].select(
        F.lit("metric").alias("kind"), "camera_id", F.col("window_start").alias("at"), "lane_id"
    )
    return events.unionByName(metrics)


@query
def retention_counts(spark, sf):
    return _sweep(spark, sf)["deleted"]


def _dated_tables(spark, sf, folder: str) -> tuple[str, str, str]:
    for name, rows, column in (("events", tb.raw_events(spark, sf), "ts"), ("metrics", _metrics(spark, sf), "window_start")):
        rows.withColumn("date", F.to_date(column)).write.partitionBy("date").parquet(f"{folder}/{name}")
    return f"{folder}/events", f"{folder}/metrics", f"{folder}/archive"


@query
def retention_job(spark, sf):
    """What the job reports, and what it leaves in both tables."""
    paths = _dated_tables(spark, sf, shared_folder(spark, "retention"))
    retention = Retention(events_hours=250, metrics_days=20)
    events, metrics = rt.retention_job(spark, *paths, _as_of(spark, sf), retention)
    left = [spark.read.parquet(p).agg(F.count(F.lit(1)).alias("n")).scalar() for p in paths[:2]]
    return spark.range(1).select(
        F.lit(events).cast("bigint").alias("events_deleted"), F.lit(metrics).cast("bigint").alias("metrics_deleted"),
        left[0].alias("events_left"), left[1].alias("metrics_left"),
    )


@query
def archive_roundtrip(spark, sf):
    """The archive as it is read back after the job."""
    paths = _dated_tables(spark, sf, shared_folder(spark, "archive"))
    rt.retention_job(spark, *paths, _as_of(spark, sf), Retention(events_hours=250, metrics_days=20))
    rows = rt.read_archive(spark, paths[2])
    return rows.select("camera_id", "date", *[c for c in wn.METRIC_COLUMNS if c != "camera_id"])


@query
def retention_restart(spark, sf):
    """Runs that end early, each time taken up by a later one, and where every metric row is in the end."""
    paths = _dated_tables(spark, sf, shared_folder(spark, "restart"))
    retention, newest = Retention(events_hours=250, metrics_days=20), _as_of(spark, sf)
    for days, until in ((4, "archived"), (1, "staged"), (0, "done")):
        rt.retention_job(spark, *paths, newest - F.make_dt_interval(days=F.lit(days)), retention, until=until)
    places = {"archive": rt.read_archive(spark, paths[2]), "table": spark.read.parquet(paths[1])}
    columns = ["camera_id", "window_start", "lane_id", "vehicle_count", "congestion_level"]
    parts = [df.select(F.lit(name).alias("place"), *columns) for name, df in places.items()]
    return parts[0].unionByName(parts[1])


@query
def archive_candidates(spark, sf):
    return _text(_sweep(spark, sf)["archive"])


def _recount(metrics: DataFrame) -> DataFrame:
    """Later figures for the windows that saw a stopped vehicle, and a window the table does not have yet."""
    stopped = metrics.filter(F.col("queue_length") > 0)
    raised = stopped.withColumn("vehicle_count", F.col("vehicle_count") + 100)
    moved = raised.withColumns({c: plus_seconds(F.col(c), 400 * DAY) for c in ("window_start", "window_end")})
    return raised.unionByName(moved)


@query
def upsert_metrics(spark, sf):
    metrics = _metrics_table(spark, sf)
    return _text(mt.upsert_metrics(metrics, _recount(metrics)))


def _judged(spark, sf) -> DataFrame:
    return mt.judge_camera_changes(tb.camera_registry(spark, sf), tb.camera_changes(spark, sf), slice_rows=2000)


@query
def camera_changes(spark, sf):
    return mt.apply_camera_changes(tb.camera_registry(spark, sf), _judged(spark, sf))


@query
def camera_change_status(spark, sf):
    return _judged(spark, sf).select("seq", "camera_id", "action", "status")


@query
def audit_rows(spark, sf):
    return mt.audit_rows(_judged(spark, sf))


@query
def valid_cameras(spark, sf):
    """Registry rows offered under ``lat`` and ``lng``, of which those out of range or incomplete fall out."""
    offered = tb.read_table(spark, sf, "customer").select(
        F.concat(F.lit("cam_"), "c_custkey").alias("camera_id"),
        F.when(F.col("c_custkey") % 10 != 3, F.col("c_name")).alias("name"),
        (F.col("c_acctbal") / 50).alias("lat"),
        (F.col("c_acctbal") / 40).alias("lng"),
        F.lit(None).cast("string").alias("road_segment"),
        F.lit(None).cast("string").alias("description"),
    )
    valid = mt.valid_cameras(offered)
    return _rounded(valid.select("camera_id", "name", "latitude", "longitude"), "latitude", "longitude")


# --- forecasting inputs --------------------------------------------------------------------------------------------


def _filled(spark, sf) -> DataFrame:
    return gf.fill_gaps(pj.lane_level(_metrics_table(spark, sf)), WINDOW, SLICE)


def _features(spark, sf) -> DataFrame:
    return _stored(ft.features(_filled(spark, sf), SHAPE), "features")


def _nodes(spark, sf) -> DataFrame:
    return _stored(gr.lane_nodes(tb.event_lanes(spark, sf)), "nodes")


def _dense(spark, sf) -> DataFrame:
    return ft.dense_signal(_features(spark, sf), _nodes(spark, sf))


@query
def gap_fill(spark, sf):
    return _filled(spark, sf)


@query
def features(spark, sf):
    return _rounded(ft.features(_filled(spark, sf), SHAPE), *ft.FEATURES)


@query
def dense_signal(spark, sf):
    return _rounded(_dense(spark, sf), *ft.FEATURES)


@query
def recent_input(spark, sf):
    recent = ft.recent_input(_features(spark, sf), _nodes(spark, sf), SHAPE.t_in)
    return _rounded(recent.drop("t_idx"), *ft.FEATURES)


def _whole_text(values: Column) -> Column:
    """Numbers as whole ten-thousandths, joined."""
    return F.array_join(F.transform(values, lambda v: F.round(v * 10_000, 0).cast("bigint").cast("string")), ",")


@query
def sliding_samples(spark, sf):
    samples = ft.sliding_samples(_dense(spark, sf), SHAPE.t_in, SHAPE.t_out)
    column = lambda i: F.transform("x", lambda row: row[i])
    inputs = [_whole_text(column(i)).alias(f"x_{name}") for i, name in enumerate(ft.FEATURES)]
    return samples.select(
        "node",
        "start",
        *inputs,
        _whole_text(F.col("y_vehicle_count")).alias("y_counts"),
        _whole_text(F.col("y_congestion_prob")).alias("y_probs"),
        F.array_join(F.col("y_congestion_level").cast("array<string>"), ",").alias("y_levels"),
    )


@query
def ewma_forecast(spark, sf):
    roster = tb.camera_registry(spark, sf)
    return tr.ewma_forecast(
        pj.camera_wide(_metrics(spark, sf)), roster=roster.select("camera_id"), slice_seconds=SLICE
    )


@query
def trend(spark, sf):
    scores = pj.camera_wide(_metrics(spark, sf))
    both = tr.ewma(scores, slice_seconds=SLICE).join(tr.trend(scores, slice_seconds=SLICE), "camera_id")
    return _rounded(both, "level", "slope")


# --- forecasts -----------------------------------------------------------------------------------------------------


def _lane_series(spark, sf) -> DataFrame:
    """A forecast per lane and day: the hourly scores of the day as its steps."""
    hourly = pj.lane_level(_metrics(spark, sf, seconds=3600))
    day = F.date_trunc("day", "window_start")
    place = F.row_number().over(ep.W.partitionBy("camera_id", "lane_id", day).orderBy("window_start")) - 1
    rows = hourly.withColumns({"origin": day, "step": place})
    return rows.select(
        "camera_id",
        "lane_id",
        "origin",
        "step",
        ep.step_time(F.col("origin"), F.col("step"), 3600).alias("predicted_at"),
        F.col("vehicle_count").cast("double").alias("vehicle_count"),
        F.col("congestion_score").alias("congestion_prob"),
        "congestion_level",
    )


@query
def congestion_episodes(spark, sf):
    return ep.episodes(_lane_series(spark, sf), EPISODE)


@query
def first_sustained(spark, sf):
    return ep.first_sustained(_lane_series(spark, sf), F.col("congestion_prob") <= 0.4, 2)


@query
def lane_summary(spark, sf):
    return ep.lane_summary(_lane_series(spark, sf), EPISODE)


@query
def congestion_outlook(spark, sf):
    outlook = ep.congestion_outlook(_lane_series(spark, sf), EPISODE, every=3)
    return outlook.withColumn("predicted_levels", F.array_join("predicted_levels", ","))


@query
def lane_detail(spark, sf):
    detail = ep.lane_forecasts(_lane_series(spark, sf), EPISODE)
    return detail.select(
        *ep.SERIES,
        "peak_probability",
        _whole_text(F.col("predicted_vehicle_counts")).alias("counts"),
        _whole_text(F.col("congestion_probabilities")).alias("probabilities"),
        F.array_join("congestion_levels", ",").alias("levels"),
        F.size("forecast_timestamps").alias("steps"),
    )


@query
def lane_report(spark, sf):
    """Everything about one lane, with the first five steps of each of its forecasts."""
    detail = ep.lane_detail(_stored(_lane_series(spark, sf), "series"), "cam_0", 1, EPISODE, 5)
    return detail.select(
        *ep.SERIES, "congestion_start", "congestion_end", "peak_congestion_probability", "current_congestion_level", "next_5min_avg_count",
        _whole_text(F.col("predicted_vehicle_counts")).alias("counts"),
        _whole_text(F.col("congestion_probabilities")).alias("probabilities"),
        F.array_join("congestion_levels", ",").alias("levels"),
        F.size("forecast_timestamps").alias("steps"),
    )


@query
def camera_forecast(spark, sf):
    return ep.camera_forecast(_lane_series(spark, sf), 12)


@query
def history_samples(spark, sf):
    return ep.history_samples(_metrics(spark, sf), _as_of(spark, sf), 5 * 1440)


@query
def forecast_messages(spark, sf):
    messages = ep.forecast_messages(_lane_series(spark, sf), _as_of(spark, sf), EPISODE)
    first = lambda field: F.get_json_object("value", f"$.forecasts[0].{field}")
    return messages.select(
        "key",
        F.get_json_object("value", "$.num_lanes").cast("bigint").alias("num_lanes"),
        F.get_json_object("value", "$.generated_at").alias("generated_at"),
        first("forecast_horizon_steps").cast("int").alias("steps"),
        first("congestion_start").alias("congestion_start"),
        first("peak_congestion_probability").cast("double").alias("peak"),
        first("congestion_end").alias("congestion_end"),
        first("summary_levels").alias("levels"),
        first("summary_timestamps").alias("times"),
        first("summary_counts").alias("counts"),
    )


@query
def forecast_metrics(spark, sf):
    quantity, discount = F.col("l_quantity"), F.col("l_discount")
    tax = F.col("l_tax")
    pairs = tb.read_table(spark, sf, "lineitem").select(
        (quantity * (1 - discount)).alias("pred_count"),
        quantity.alias("count"),
        (discount * 9).alias("pred_prob"),
        (tax * 11).alias("prob"),
        F.floor(discount * 30).alias("pred_level"),
        F.floor(tax * 35).alias("level"),
    )
    quality = ql.forecast_metrics(pairs)
    return _rounded(quality, *quality.columns)


# --- lane graph and sensors ----------------------------------------------------------------------------------------


def _volume_nodes(spark, sf) -> DataFrame:
    return gr.lane_nodes(tb.lane_topology(spark, sf))


def _volume_edges(spark, sf) -> DataFrame:
    lanes = tb.lane_topology(spark, sf)
    return gr.lane_edges(gr.lane_nodes(lanes), lanes, tb.cross_links(spark, sf))


def _lane_graph(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of the lanes in the detections, stored. The detections are read once for both."""
    lanes = _stored(tb.event_lanes(spark, sf), "lanes")
    nodes = _stored(gr.lane_nodes(lanes), "nodes")
    links = lanes.filter(F.col("lane_id") == 1).select(
        F.col("camera_id").alias("from_camera"),
        F.col("lane_id").alias("from_lane"),
        F.concat(F.lit("cam_"), F.col("camera_pos") + 1).alias("to_camera"),
        F.lit(1).alias("to_lane"),
    )
    return nodes, _stored(gr.lane_edges(nodes, lanes, links), "edges")


def _signal(spark, sf) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The dense signal, and nodes and edges of its graph, stored."""
    nodes, edges = _lane_graph(spark, sf)
    return _stored(ft.dense_signal(_features(spark, sf), nodes), "dense"), nodes, edges


@query
def lane_nodes(spark, sf):
    return _volume_nodes(spark, sf)


@query
def lane_edges(spark, sf):
    return _volume_edges(spark, sf)


@query
def khop_neighbours(spark, sf):
    return gr.khop(_stored(_volume_edges(spark, sf), "edges"), 2)


@query
def neighbour_means(spark, sf):
    dense, _, edges = _signal(spark, sf)
    means = gr.neighbour_means(dense, edges, ["vehicle_count", "congestion_score"], 2)
    names = [f"{c}_hop{h}" for h in (1, 2) for c in ("vehicle_count", "congestion_score")]
    return _rounded(means.select("t_idx", "node", *names), *names)


CHEBYSHEV = ["vehicle_count", "congestion_score"]


@query
def chebyshev_features(spark, sf):
    dense, _, edges = _signal(spark, sf)
    names = [f"{c}_cheb{k}" for k in (1, 2) for c in CHEBYSHEV]
    return _rounded(gr.chebyshev_features(dense, edges, CHEBYSHEV, 3).select("t_idx", "node", *names), *names)


@query
def sensor_import(spark, sf):
    return _text(sn.import_sensor_series(tb.sensor_readings(spark, sf), tb.sensor_mapping(spark, sf)))


@query
def sensor_links(spark, sf):
    return sn.map_adjacency(tb.sensor_edges(spark, sf), tb.sensor_mapping(spark, sf))


# --- Spark ML ------------------------------------------------------------------------------------------------------


@query
def training_table(spark, sf):
    values = F.col("history_values")
    dense, _, edges = _signal(spark, sf)
    rows = ml.training_table(dense, edges, SHAPE).withColumn("history_values", ml.vector_to_array("history"))
    return rows.select(
        "node", "start", "step", round_stable(F.col("count"), 6).alias("count"), "prob", "level",
        F.size(values).alias("width"),
        round_stable(F.aggregate(F.slice(values, 1, 4 * SHAPE.t_in + 4), F.lit(0.0), lambda a, v: a + v), 6).alias("total"),
    )


def _forecast(spark, sf) -> DataFrame:
    """Every lane from the newest steps, by a model of all samples before them."""
    dense, nodes, edges = _signal(spark, sf)
    samples = _stored(ml.training_table(dense, edges, SHAPE), "samples")
    return ml.predict_lanes(ml.fit_forecaster(samples, SHAPE), dense, nodes, edges, SHAPE)


@query
def ml_forecast(spark, sf):
    return _forecast(spark, sf)


@query
def ml_episodes(spark, sf):
    """Congestion episodes of the model's own forecast."""
    return ml.predict_episodes(_stored(_forecast(spark, sf), "forecast"), EPISODE)


@query
def ml_evaluation(spark, sf):
    """Errors on the newest tenth of the samples, which the chosen model has not seen, beside those of persistence."""
    dense, _, edges = _signal(spark, sf)
    samples = _stored(ml.training_table(dense, edges, SHAPE), "samples")
    parts = ml.split_by_time(samples, validation=0.3, gap=SHAPE.t_in + SHAPE.t_out)
    train, validation, test = (_stored(part, "part") for part in parts)
    model = ml.select_model(train, validation, SHAPE)
    ours = ml.evaluate(model, test).withColumn("method", F.lit("model"))
    return ours.unionByName(ml.persistence(test, SHAPE).withColumn("method", F.lit("persistence")))


# --- streaming -----------------------------------------------------------------------------------------------------


def _drain(stream: DataFrame, folder: str) -> DataFrame:
    """Run a stream over everything there is and return what it wrote."""
    started = ssk.write_raw(stream, f"{folder}/table", f"{folder}/checkpoint", every=None)
    started.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/table")


def _arriving(spark, sf, folder: str, arrivals: list[datetime] = ARRIVALS):
    """The detections as a stream that grows by some days at a time; a step of the loop for each growth."""
    stream = None
    for begin, end in zip(arrivals, [*arrivals[1:], None], strict=True):
        rows = tb.raw_events(spark, sf, None if begin is arrivals[0] else begin, end)
        rows.write.mode("append").parquet(f"{folder}/events")
        stream = stream or spark.readStream.schema(rows.schema).parquet(f"{folder}/events")
        yield stream


@query
def stream_window_metrics(spark, sf):
    stream = smt.stream_metrics(tb.raw_events(spark, sf, stream=True), WINDOW, scoring=SCORING)
    return _text(_drain(stream, shared_folder(spark, "stream_metrics")))


@query
def stream_rollup(spark, sf):
    stream = smt.stream_rollup(tb.raw_events(spark, sf, stream=True), WINDOW, DAY, scoring=SCORING)
    rolled = _drain(stream, shared_folder(spark, "stream_rollup"))
    return _rounded(rolled, "average_congestion", "average_speed_kmh")


@query
def stream_speed(spark, sf):
    """Detections that arrive in several batches, each vehicle's positions carried from one to the next."""
    folder = shared_folder(spark, "stream_speed")
    for events in _arriving(spark, sf, folder, ARRIVALS[::2]):
        filled = _drain(ssp.stream_fill_speed(events, CALIBRATION, SPEED), f"{folder}/speed")
    return _rounded(filled.select("frame_id", "camera_id", "vehicle_id", "ts", "speed_kmh"), "speed_kmh")


@query
def stream_rejects(spark, sf):
    """Records through a live ingest in two batches: what it has counted per reason, and what is in its tables."""
    folder = shared_folder(spark, "stream_rejects")
    paths = [f"{folder}/{name}" for name in ("accepted", "rejected", "counts")]
    events = tb.read_table(spark, sf, "events")
    for part in (F.col("event_id") % 2 == 0, F.col("event_id") % 2 == 1):
        tb.detection_messages(events.filter(part)).write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema("value string").parquet(f"{folder}/in")
        sin.ingest(stream, *paths, f"{folder}/checkpoint", every=None).awaitTermination()
    rejected = spark.read.parquet(paths[1]).groupBy("reject_reason").agg(F.count(F.lit(1)).alias("written"))
    accepted = spark.read.parquet(paths[0]).agg(F.lit(None).cast("string").alias("reject_reason"), F.count(F.lit(1)).alias("written"))
    counted = sin.read_reject_counts(spark, paths[2])
    written = rejected.unionByName(accepted).withColumnRenamed("reject_reason", "_reason")
    return counted.join(written, F.col("reject_reason").eqNullSafe(F.col("_reason")), "full_outer").drop("_reason")


@query
def stream_alerts(spark, sf):
    """Alerts of a metrics table that arrives in several batches."""
    folder = shared_folder(spark, "stream_alerts")
    for events in _arriving(spark, sf, folder):
        _drain(smt.stream_metrics(events, WINDOW, scoring=SCORING), f"{folder}/metrics")
        rows = smt.read_metrics_stream(spark, f"{folder}/metrics/table")
        changes = _drain(sal.stream_alerts(rows, tb.camera_registry(spark, sf)), f"{folder}/alerts")
    return sal.current_alerts(changes)


@query
def stream_detections_to_alerts(spark, sf):
    """Windows and alerts of one query over several batches of detections."""
    folder = shared_folder(spark, "stream_chain")
    for events in _arriving(spark, sf, folder):
        changes = sal.detections_to_alerts(events, tb.camera_registry(spark, sf), WINDOW, scoring=SCORING)
        changes = _drain(changes, f"{folder}/alerts")
    return sal.current_alerts(changes)


def _late_tables(spark, sf) -> str:
    """The tables that a stream leaves whose first batch lacks every fifth detection, which comes with the second."""
    folder, rows = shared_folder(spark, "late"), tb.raw_events(spark, sf)
    late = F.col("frame_id") % 5 == 0
    registry = tb.camera_registry(spark, sf)
    for part in (~late, late):
        rows.filter(part).write.mode("append").parquet(f"{folder}/events")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/events")
        slt.stream_late_windows(stream, registry, folder, f"{folder}/checkpoint", 40, None, WINDOW, SCORING).awaitTermination()
    return folder


@query
def stream_late_windows(spark, sf):
    """Windows that late detections have opened again."""
    return _text(slt.read_late_metrics(spark, _late_tables(spark, sf)))


@query
def stream_late_alerts(spark, sf):
    """Alerts after what late detections have retracted."""
    return slt.read_late_alerts(spark, _late_tables(spark, sf))


@query
def stream_alerts_takeover(spark, sf):
    """A stream with a new checkpoint that goes on from the alerts table of the windows before it."""
    folder = shared_folder(spark, "stream_takeover")
    metrics, registry = _metrics_table(spark, sf), tb.camera_registry(spark, sf)
    before = F.col("window_start") < pj.moment(RANGE_A[1])
    existing = _stored(_alerts(spark, sf, metrics.filter(before)), "existing")
    metrics.filter(~before).write.parquet(f"{folder}/metrics")
    rows = smt.read_metrics_stream(spark, f"{folder}/metrics")
    return sal.current_alerts(_drain(sal.stream_alerts(rows, registry, existing), f"{folder}/alerts"), existing)


@query
def stream_upsert(spark, sf):
    """The windows, later figures for some of them, old dates folded, and the last batch once more, as after a crash."""
    folder = shared_folder(spark, "stream_upsert")
    metrics = _metrics_table(spark, sf)
    for n, rows in enumerate((metrics, _recount(metrics))):
        rows.write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(metrics.schema).parquet(f"{folder}/in/*")
        sup.upsert_stream(stream, f"{folder}/table", f"{folder}/checkpoint", every=None).awaitTermination()
    sup.compact_upserts(spark, f"{folder}/table", RANGE_B[1].date())
    sup.log_batch(spark.read.schema(metrics.schema).parquet(f"{folder}/in/1"), f"{folder}/table", 1)
    return _text(sup.read_upserted(spark, f"{folder}/table").drop("date"))


@query
def sketched_vehicles(spark, sf):
    """Distinct vehicles per camera and day, and of all cameras, from merged sketches of six hours, beside exact counts.

    The sketches are stored first, so that merging them reads no detections. ``within`` says that the estimate is
    within four standard errors of the exact count.
    """
    events = tb.raw_events(spark, sf)
    wide = _stored(sk.window_sketches(events, WINDOW), "sketches").filter("lane_id IS NULL")
    parts = [sk.sketched_metrics(sk.merge_sketches(wide, DAY, keys), SCORING) for keys in (("camera_id", "lane_id"), ())]
    estimates = parts[0].unionByName(parts[1]).select("camera_id", "window_start", "vehicle_count")
    per_day = events.select("camera_id", "vehicle_id", F.date_trunc("day", "ts").alias("day"))
    alone = per_day.groupBy("day", "camera_id").agg(F.count_distinct("vehicle_id").alias("vehicles"))
    exact = alone.unionByName(per_day.groupBy("day").agg(F.lit(None).cast("string").alias("camera_id"), F.count_distinct("vehicle_id").alias("vehicles")))
    same = (F.col("window_start") == F.col("day")) & estimates["camera_id"].eqNullSafe(exact["camera_id"])
    off = F.abs(F.col("vehicle_count") - F.col("vehicles"))
    joined = estimates.join(exact, same, "full_outer")
    return joined.select(
        exact["camera_id"], "day", "vehicles", (off <= F.ceil(4 * sk.standard_error() * F.col("vehicles"))).alias("within")
    )


def _hours(spark, sf) -> DataFrame:
    """The roll-up that a stream of windows, and of later figures for some of them, has left."""
    folder = shared_folder(spark, "hours")
    metrics = _metrics_table(spark, sf)
    for n, rows in enumerate((metrics, _recount(metrics))):
        rows.write.parquet(f"{folder}/in/{n}")
        stream = spark.readStream.schema(metrics.schema).parquet(f"{folder}/in/*")
        sup.upsert_stream_and_hours(stream, f"{folder}/table", f"{folder}/hours", f"{folder}/checkpoint", every=None).awaitTermination()
    sup.compact_upserts(spark, f"{folder}/hours", RANGE_B[1].date(), sup.HOURS)
    return sup.read_hours(spark, f"{folder}/hours")


@query
def rollup_hours(spark, sf):
    hours = _hours(spark, sf)
    return hours.select(*ru.KEY, *[F.col(c).cast("double").alias(c) for c in ("score_sum", "speed_sum")], *[c for c in ru.SHARES if c not in ("score_sum", "speed_sum")])


@query
def rollup_summaries(spark, sf):
    """What the roll-up says of both ranges, and its incidents of the first."""
    hours = _stored(_hours(spark, sf), "hours")
    both = ru.compare_ranges(hours, RANGE_A, RANGE_B)
    counts = ru.incident_summary(hours, *RANGE_A)
    row = both.select("*", *[counts.select(c).scalar().alias(f"incidents_{c}") for c in counts.columns])
    return _rounded(row, *[f.name for f in row.schema if isinstance(f.dataType, T.DoubleType)])


@query
def rollup_top_segments(spark, sf):
    top = ru.top_segments(_hours(spark, sf), tb.camera_registry(spark, sf), *RANGE_B)
    return _rounded(top, "average_congestion", "average_queue_length")


@query
def rollup_trends(spark, sf):
    return _rounded(ru.hourly_trends(_hours(spark, sf), *RANGE_A), "average_congestion", "average_speed_kmh")


@query
def stream_snapshots(spark, sf):
    """What subscribers get of the newest window of a dated metrics table."""
    folder = shared_folder(spark, "stream_snapshots")
    metrics = _metrics_table(spark, sf)
    dated = metrics.withColumn("date", F.to_date("window_start"))
    dated.write.partitionBy("date").parquet(f"{folder}/metrics")
    stream = spark.readStream.schema(metrics.schema).parquet(f"{folder}/metrics")
    started = ssk.publish_snapshots(
        stream, f"{folder}/metrics", f"{folder}/out", f"{folder}/checkpoint", minutes=1440, every=None
    )
    started.awaitTermination()
    field = lambda c: F.get_json_object("data", f"$.{c}")
    return spark.read.parquet(f"{folder}/out").select(
        "event", field("camera_id").alias("camera_id"), field("vehicle_count").cast("bigint").alias("vehicle_count"),
        field("congestion_level").alias("congestion_level"), field("avg_vehicle_count").cast("double").alias("avg_vehicle_count"),
    )


@query
def stream_events(spark, sf):
    """New alerts of a metrics stream as envelopes, as a subscriber to that type sees them."""
    folder = shared_folder(spark, "stream_events")
    metrics = smt.stream_metrics(tb.raw_events(spark, sf, stream=True), WINDOW, scoring=SCORING)
    _drain(metrics, f"{folder}/metrics")
    rows = smt.read_metrics_stream(spark, f"{folder}/metrics/table", lateness_seconds=WINDOW)
    envelopes = sev.to_envelope(al.new_alerts(rows), "new_alert")
    seen = sev.select_events(_drain(envelopes, f"{folder}/events"), "new_alert, admin_broadcast")
    return seen.select(
        "event",
        *[F.get_json_object("data", f"$.{c}").alias(c) for c in ("camera_id", "severity", "window_end")],
        F.get_json_object("data", "$.score").cast("double").alias("score"),
    )


@query
def event_envelopes(spark, sf):
    snapshot = lt.latest_per_camera(_metrics(spark, sf)).select("camera_id", "vehicle_count", "congestion_level")
    heat = db.heat_snapshot(_metrics(spark, sf), _as_of(spark, sf), 1440).select("camera_id", "avg_vehicle_count")
    both = sev.to_envelope(snapshot, "traffic_metrics_update", _as_of(spark, sf)).unionByName(
        sev.to_envelope(heat, "heatmap_update", _as_of(spark, sf))
    )
    return sev.select_events(both, camera_id="cam_0")
