"""A live stream of records into accepted detections, refused records and counts per reason."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadpulse.operators.projections import flatten_event
from roadpulse.schemas import DETECTION
from roadpulse.sources.detections import type_detections
from roadpulse.streaming.sinks import start, write_batch


def ingest(
    records: DataFrame,
    accepted_path: str,
    rejected_path: str,
    counts_path: str,
    checkpoint: str,
    every: str | None = "1 second",
) -> StreamingQuery:
    """Parse each record once and write it to one of two tables, and the batch's counts to a third.

    Accepted records become raw events below ``date=/batch=``, refused ones ``(value, reject_reason, batch)``, and the counts
    ``(reject_reason, records, batch)``, with NULL for accepted. The parsed batch is kept while both are written.
    Each table has a partition per batch that a replay replaces, whatever the first try has left of them, so that the
    accepted and the refused rows of a batch add up to its input. A batch without records leaves no partition.
    """

    def split(rows: DataFrame, batch_id: int) -> None:
        typed = type_detections(rows.select("value")).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            refused = F.col("reject_reason").isNotNull()
            write_batch(flatten_event(typed.filter(~refused).select(*DETECTION.fieldNames())), accepted_path, batch_id, "ts")
            write_batch(typed.filter(refused).select("value", "reject_reason"), rejected_path, batch_id)
            write_batch(typed.groupBy("reject_reason").agg(F.count(F.lit(1)).alias("records")), counts_path, batch_id)
        finally:
            typed.unpersist()

    return start(records.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint), every)


def read_reject_counts(spark: SparkSession, counts_path: str) -> DataFrame:
    """Records per reason over all batches; NULL is accepted."""
    rows = spark.read.schema("reject_reason string, records bigint, batch bigint").parquet(counts_path)
    return rows.groupBy("reject_reason").agg(F.sum("records").alias("records"))
