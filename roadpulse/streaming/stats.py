"""What a running query has processed."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

STATS = (
    "query string, batch bigint, at string, input_rows bigint, rows_per_second double, dropped_late bigint, "
    "state_rows bigint, batch_ms bigint, write_ms bigint, observed string"
)


def observe_detections(typed: DataFrame, name: str = "detections") -> DataFrame:
    """Let the query report accepted and refused records with every batch, without a pass of its own."""
    refused = F.col("reject_reason").isNotNull()
    return typed.observe(name, F.count_if(~refused).alias("accepted"), F.count_if(refused).alias("rejected"))


def _row(progress: dict) -> tuple:
    states = progress.get("stateOperators") or []
    duration = progress.get("durationMs") or {}
    return (
        progress.get("name") or progress.get("id"),
        progress.get("batchId"),
        progress.get("timestamp"),
        progress.get("numInputRows"),
        float(progress.get("processedRowsPerSecond") or 0.0),
        sum(s.get("numRowsDroppedByWatermark", 0) for s in states),
        sum(s.get("numRowsTotal", 0) for s in states),
        duration.get("triggerExecution"),
        duration.get("addBatch"),
        json.dumps(progress.get("observedMetrics") or {}),
    )


def stream_stats(query: StreamingQuery) -> DataFrame:
    """One row per recent batch of a query; Spark keeps only the newest of them, ``stats_table`` keeps all."""
    rows = [_row(json.loads(p.json)) for p in query.recentProgress]
    return SparkSession.active().createDataFrame(rows, STATS)


def stats_table(spark: SparkSession, path: str):
    """A sink for ``StatsListener`` that keeps every batch's statistics as a file of one JSON record below ``path``."""

    def append(row: dict) -> None:
        jvm = spark._jvm
        place = jvm.org.apache.hadoop.fs.Path(f"{path}/{uuid.uuid4().hex}.json")
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place)
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()

    return append


def read_stats(spark: SparkSession, path: str) -> DataFrame:
    """All statistics that ``stats_table`` has kept; a batch that was reported twice counts once."""
    return spark.read.schema(STATS).json(path).dropDuplicates(["query", "batch", "at"])


class StatsListener(StreamingQueryListener):
    """Hand each batch's statistics of every query of a session to ``sink``, for example a metrics client."""

    def __init__(self, sink) -> None:
        self._sink = sink

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self._sink(dict(zip([f.split()[0] for f in STATS.split(", ")], _row(json.loads(event.progress.json)))))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass
