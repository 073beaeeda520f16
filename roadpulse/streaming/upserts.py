"""B2: tables that a stream updates, with versions that readers can hold on to.

Every batch writes a folder of its own, compaction too, and none is ever written twice. Which folders make up the table is
said by a manifest; each change makes the next version of it, and only one writer can make a given version. A reader
takes the newest version and sees it unchanged, whatever is committed meanwhile. ``vacuum_upserts`` deletes what old
versions alone refer to.

For each date the manifest names the folder with the folded rows, the batch up to which they are folded, and later batches.
A batch that Spark replays after it was folded changes nothing, as its rows are in the fold.

How rows of several batches make one is the table's kind: of metrics the newest batch wins, of shares (E8-E13) all add up.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from datetime import date
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from roadpulse.operators.maintenance import METRIC_KEY
from roadpulse.operators.rollups import SHARES, add_shares, share_changes, share_type
from roadpulse.operators.windows import METRIC_COLUMNS
from roadpulse.plans.journal import Journal, Store
from roadpulse.schemas import METRIC
from roadpulse.streaming.sinks import start

KEPT_VERSIONS = 20


@dataclass(frozen=True)
class Kind:
    """What a table holds: its columns, the time that dates a row, and how rows (with date and batch) of a key make one."""

    schema: T.StructType
    dated_by: str
    fold: Callable[[DataFrame], DataFrame]


def _newest(log: DataFrame) -> DataFrame:
    """The newest batch of each key wins. Key and date are grouping columns, so that filters on them reach the scan."""
    others = [c for c in METRIC_COLUMNS if c not in METRIC_KEY]
    newest = F.max_by(F.struct("batch", *others), "batch").alias("row")
    return log.groupBy(*METRIC_KEY, "date").agg(newest).select(*METRIC_KEY, "date", "row.*")


METRICS = Kind(METRIC, "window_start", _newest)
_SHARE = [T.StructField(name, share_type(name)) for name in SHARES]
HOURS = Kind(
    T.StructType([T.StructField("camera_id", T.StringType()), T.StructField("hour_start", T.TimestampType()), *_SHARE]),
    "hour_start",
    lambda log: add_shares(log, "date").withColumn("batch", F.lit(-1).cast("long")),
)


def _manifest(spark: SparkSession, path: str) -> tuple[Journal, int, dict]:
    """The journal of versions, the newest version and what it says: per date ``fold``, ``upto`` and ``batches``."""
    log = Journal(spark, f"{path}/manifest")
    while True:
        names = log.names()
        if not names:
            return log, 0, {}
        try:
            return log, int(names[-1].split("-")[1]), log.get(names[-1])
        except Exception:  # a vacuum has just taken it; there is a newer one
            if log.names()[-1] == names[-1]:
                raise


def _commit(spark: SparkSession, path: str, change: Callable[[dict], dict]) -> int:
    """Make the next version; another writer's version in between is taken into account."""
    while True:
        log, version, dates = _manifest(spark, path)
        if log.put(f"v-{version + 1:012}", change(dates)):
            return version + 1


def _write(rows: DataFrame, path: str, name: str) -> tuple[str, list[str]]:
    """Write rows (with date and batch) into a new folder; its name and the dates in it."""
    part = f"{name}-{uuid.uuid4().hex}"
    folder = f"{path}/data/part={part}"
    rows.write.partitionBy("date").parquet(folder)
    found = Store(rows.sparkSession).names(folder)
    return part, sorted(n.removeprefix("date=") for n in found if n.startswith("date="))


def log_batch(rows: DataFrame, path: str, batch_id: int, kind: Kind = METRICS) -> None:
    """Write one batch and make it part of the table. A batch that comes again takes the place of its first coming."""
    dated = rows.select(
        *kind.schema.fieldNames(), F.to_date(kind.dated_by).alias("date"), F.lit(batch_id).cast("long").alias("batch")
    )
    part, days = _write(dated, path, f"batch{batch_id}")
    if not days:
        return

    def add(dates: dict) -> dict:
        for entry in dates.values():
            entry["batches"].pop(str(batch_id), None)
        for day in days:
            entry = dates.setdefault(day, {"fold": None, "upto": -1, "batches": {}})
            if batch_id > entry["upto"]:
                entry["batches"][str(batch_id)] = part
        return {day: e for day, e in dates.items() if e["fold"] or e["batches"]}

    _commit(rows.sparkSession, path, add)


def upsert_stream(metrics: DataFrame, path: str, checkpoint: str, every: str | None = "5 seconds") -> StreamingQuery:
    """B2: take each batch of metric rows into the table. A batch writes only its own rows, whatever the table's size."""
    writer = metrics.writeStream.foreachBatch(lambda rows, batch_id: log_batch(rows, path, batch_id))
    return start(writer.option("checkpointLocation", checkpoint), every)


def log_batch_and_hours(rows: DataFrame, path: str, hours_path: str, batch_id: int) -> None:
    """Take a batch (one row per key) into the table of metrics and its difference into the table of hours.

    The difference is to the rows that the batch replaces, which are looked up in the dates of the batch only. It is
    committed before the batch is. A batch that comes again finds out whether it is in the table of metrics: if so its
    difference was committed whole, if not it is worked out again, from the same rows, and takes the place of the first.
    """
    spark = rows.sparkSession
    log, _, dates = _manifest(spark, path)
    if not any(e["upto"] >= batch_id or str(batch_id) in e["batches"] for e in dates.values()):
        rows = rows.select(*METRIC_COLUMNS).persist()
        days = [str(r["date"]) for r in rows.select(F.to_date("window_start").alias("date")).distinct().collect()]
        touched = _newest(_log(spark, path, {d: e for d, e in dates.items() if d in days}))
        keys = rows.select(*[F.col(c).alias(f"_{c}") for c in METRIC_KEY])
        replaced = touched.join(keys, reduce(and_, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in METRIC_KEY]), "left_semi")
        log_batch(share_changes(replaced, rows), hours_path, batch_id, HOURS)
        log_batch(rows, path, batch_id)
        rows.unpersist()


def upsert_stream_and_hours(
    metrics: DataFrame, path: str, hours_path: str, checkpoint: str, every: str | None = "5 seconds"
) -> StreamingQuery:
    """``upsert_stream`` that keeps the roll-up of ``operators.rollups`` beside the table."""
    writer = metrics.writeStream.foreachBatch(lambda rows, batch_id: log_batch_and_hours(rows, path, hours_path, batch_id))
    return start(writer.option("checkpointLocation", checkpoint), every)


def read_hours(spark: SparkSession, hours_path: str) -> DataFrame:
    """The roll-up as it is now; hours that hold no windows any more are left out."""
    return read_upserted(spark, hours_path, kind=HOURS).drop("date").filter("windows > 0")


def _parts(dates: dict) -> list[str]:
    return [
        f"part={part}/date={day}"
        for day, entry in dates.items()
        for part in ([entry["fold"]] if entry["fold"] else []) + list(entry["batches"].values())
    ]


def _log(spark: SparkSession, path: str, dates: dict, kind: Kind = METRICS) -> DataFrame:
    """All rows behind some dates of a version, with ``date`` and ``batch``."""
    if not dates:
        schema = T.StructType([*kind.schema.fields, T.StructField("date", T.DateType()), T.StructField("batch", T.LongType())])
        return spark.createDataFrame([], schema)
    places = [f"{path}/data/{p}" for p in _parts(dates)]
    return spark.read.option("basePath", f"{path}/data").parquet(*places).drop("part")


def read_upserted(spark: SparkSession, path: str, version: int | None = None, kind: Kind = METRICS) -> DataFrame:
    """B2: the table with its ``date``, as the newest version has it, or an earlier one that is still kept.

    A filter on ``date`` prunes folders, one on the key is pushed into the files.
    """
    log, _, dates = _manifest(spark, path)
    dates = dates if version is None else log.get(f"v-{version:012}")
    return kind.fold(_log(spark, path, dates, kind)).select(*kind.schema.fieldNames(), "date")


def dates_of(spark: SparkSession, path: str) -> list[str]:
    """B2: the dates that the table has rows of, from its manifest alone."""
    return sorted(_manifest(spark, path)[2])


def read_dates(spark: SparkSession, path: str, days: list[str], kind: Kind = METRICS) -> DataFrame:
    """B2: the rows of some dates, without a look at others."""
    dates = {d: e for d, e in _manifest(spark, path)[2].items() if d in set(days)}
    return kind.fold(_log(spark, path, dates, kind)).select(*kind.schema.fieldNames(), "date")


def compact_upserts(spark: SparkSession, path: str, before: date, kind: Kind = METRICS) -> int:
    """B2: fold the batches of each date before ``before``; the number of folders that readers need no longer.

    The folds are a version of their own. Stopped before that, the job has changed nothing and can run again; batches
    that are committed meanwhile stay beside the fold. A date that another compaction has folded meanwhile is left to it.
    """
    _, _, dates = _manifest(spark, path)
    old = {d: e for d, e in dates.items() if d < before.isoformat() and len(_parts({d: e})) > 1}
    if not old:
        return 0
    part, _ = _write(kind.fold(_log(spark, path, old, kind)), path, "fold")
    gone = 0

    def fold(now: dict) -> dict:
        nonlocal gone
        gone = 0
        for day, entry in old.items():
            if now.get(day, {}).get("fold") != entry["fold"]:
                continue
            upto = max([entry["upto"], *map(int, entry["batches"])])
            later = {n: p for n, p in now[day]["batches"].items() if int(n) > upto}
            gone += len(_parts({day: now[day]})) - len(later) - 1
            now[day] = {"fold": part, "upto": upto, "batches": later}
        return now

    _commit(spark, path, fold)
    return gone


def vacuum_upserts(spark: SparkSession, path: str, kept_versions: int = KEPT_VERSIONS, older_than_seconds: int = 86_400) -> int:
    """B2: delete all but the newest versions, and folders older than that which none of these refers to; how many.

    The age protects batches that are being written. Readers of a deleted version fail.
    """
    store = Store(spark)
    log = Journal(spark, f"{path}/manifest")
    names = log.names()
    for name in names[: -max(1, kept_versions)]:
        log.drop(name)
    needed = {p.split("/")[0] for name in names[-max(1, kept_versions) :] for p in _parts(log.get(name))}
    gone = [p for p in store.names(f"{path}/data") if p not in needed and store.age(f"{path}/data/{p}") > older_than_seconds]
    return sum(store.delete(f"{path}/data/{p}") for p in gone)
