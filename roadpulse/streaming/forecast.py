"""A new forecast whenever new metrics have come in, at most once per interval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from roadpulse.config import Episode, ForecastWindow
from roadpulse.operators.episodes import forecast_messages
from roadpulse.operators.features import dense_signal, features
from roadpulse.operators.forecast_ml import Forecaster, predict_lanes
from roadpulse.operators.gapfill import fill_gaps
from roadpulse.operators.projections import recent_lanes
from roadpulse.streaming.sinks import newest_window, recent, write_batch


def recent_signal(metrics: DataFrame, nodes: DataFrame, as_of, minutes: int, window: ForecastWindow) -> DataFrame:
    """Dense signal of the last minutes before ``as_of``."""
    lanes = recent_lanes(metrics, as_of, minutes)
    return dense_signal(features(fill_gaps(lanes, window.step_seconds), window), nodes)


def stream_forecast(
    trigger_rows: DataFrame,
    metrics_path: str,
    model: Forecaster,
    nodes: DataFrame,
    edges: DataFrame,
    out_path: str,
    checkpoint: str,
    lookback_minutes: int = 10,
    window: ForecastWindow = ForecastWindow(),
    episode: Episode = Episode(),
    every: str | None = "5 seconds",
) -> StreamingQuery:
    """Each trigger scores all lanes once and writes the messages of B5 under its batch number.

    A batch counts as done only after its messages are written; if it fails, it runs again and replaces them.
    """
    spark = trigger_rows.sparkSession

    def predict(rows: DataFrame, batch_id: int) -> None:
        as_of = newest_window(rows)
        if as_of is None:
            return
        metrics = recent(spark.read.parquet(metrics_path), as_of, lookback_minutes)
        dense = recent_signal(metrics, nodes, as_of, lookback_minutes, window)
        forecast = predict_lanes(model, dense, nodes, edges, window)
        write_batch(forecast_messages(forecast, as_of, episode), out_path, batch_id)

    writer = trigger_rows.writeStream.foreachBatch(predict).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()
