"""Streaming sinks. A checkpoint and an idempotent write make each batch count once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadpulse.operators.dashboard import heat_snapshot
from roadpulse.operators.latest import latest_per_camera
from roadpulse.operators.windows import METRIC_COLUMNS
from roadpulse.session import drop_folder
from roadpulse.streaming.events import to_envelope


def start(writer, every: str | None) -> StreamingQuery:
    """Start a query; without ``every`` it drains its source and stops."""
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def write_raw(
    df: DataFrame, path: str, checkpoint: str, every: str | None = "1 second", dated_by: str | None = None
) -> StreamingQuery:
    """B1: append rows as Parquet, one commit per trigger. Without ``every`` the stream drains and stops.

    Also the sink for windowed metrics, as the watermark lets each window out once. ``dated_by`` names the time whose
    date the table is partitioned by, so that readers of a few days list and read only these. A dated table has
    no list of its files, so that retention may delete some: each batch has its own partition, which a replay replaces.
    """
    if dated_by:
        writer = df.writeStream.foreachBatch(lambda rows, batch_id: write_batch(rows, path, batch_id, dated_by))
    else:
        writer = df.writeStream.format("parquet").option("path", path)
    return start(writer.option("checkpointLocation", checkpoint), every)


def recent(table: DataFrame, as_of: Column, minutes: int) -> DataFrame:
    """Rows of a table of windows from the ``minutes`` before ``as_of``; of a dated table only these days are read."""
    start = as_of - F.make_dt_interval(mins=F.lit(minutes))
    if "date" in table.columns:
        table = table.filter(F.col("date").between(F.to_date(start), F.to_date(as_of)))
    return table.filter((F.col("window_start") >= start) & (F.col("window_end") <= as_of))


def newest_window(rows: DataFrame) -> Column | None:
    """End of the newest window of a batch, as a column that no zone can move; None if there are no rows."""
    micros = rows.agg(F.max(F.unix_micros("window_end"))).first()[0]
    return None if micros is None else F.timestamp_micros(F.lit(micros))


def write_batch(rows: DataFrame, path: str, batch_id: int, date: str | None = None) -> None:
    """Write one batch into its own partition; a replayed batch replaces what it wrote before."""
    parts = ["date", "batch"] if date else ["batch"]
    if date:
        rows = rows.withColumn("date", F.to_date(date))
    rows = rows.withColumn("batch", F.lit(batch_id).cast("long"))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)


def _kept_latest(spark: SparkSession, path: str, batch_id: int) -> tuple[DataFrame | None, list[int]]:
    """The latest rows that the newest batch before ``batch_id`` left, and the numbers of all before it."""
    try:
        log = spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):  # not there, or without rows
            raise
        return None, []
    batches = sorted(row[0] for row in log.select("batch").filter(F.col("batch") < batch_id).distinct().collect())
    return (log.filter(F.col("batch") == batches[-1]).select(*METRIC_COLUMNS) if batches else None), batches


def publish_snapshots(
    trigger_rows: DataFrame,
    metrics_path: str,
    out_path: str,
    checkpoint: str,
    minutes: int = 5,
    every: str | None = "5 seconds",
    lookback_minutes: int = 1440,
) -> StreamingQuery:
    """On every trigger, the latest metrics and the heat of the last minutes as envelopes.

    ``trigger_rows`` is the metrics stream; its newest window is the moment the snapshot describes. The latest row of
    every camera, however long it has been silent, is kept in ``<out_path>_latest`` from batch to batch; the first batch
    reads it from the whole metrics table, later ones add their own rows and the table's last ``lookback_minutes``.
    """
    spark, kept_path = trigger_rows.sparkSession, out_path.rstrip("/") + "_latest"

    def publish(rows: DataFrame, batch_id: int) -> None:
        as_of = newest_window(rows)
        if as_of is None:
            return
        table = spark.read.parquet(metrics_path)
        metrics = recent(table, as_of, max(minutes, lookback_minutes)).drop("date")
        kept, batches = _kept_latest(spark, kept_path, batch_id)
        known = table.filter(F.col("window_end") <= as_of) if kept is None else kept.unionByName(metrics.select(*METRIC_COLUMNS))
        newest = latest_per_camera(known.select(*METRIC_COLUMNS).unionByName(rows.select(*METRIC_COLUMNS))).persist()
        write_batch(newest, kept_path, batch_id)
        latest = to_envelope(newest, "traffic_metrics_update", as_of)
        heat = to_envelope(heat_snapshot(metrics, as_of, minutes), "heatmap_update", as_of)
        write_batch(latest.unionByName(heat), out_path, batch_id)
        newest.unpersist()
        for old in batches[:-1]:
            drop_folder(spark, f"{kept_path}/batch={old}")

    return start(trigger_rows.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint), every)
