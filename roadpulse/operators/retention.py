"""Retention as a job that may be stopped at any moment and run again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.config import Retention
from roadpulse.operators.maintenance import archive_metrics
from roadpulse.operators.projections import Moment, moment
from roadpulse.plans.journal import Journal, Store

#: The steps of a run, in order. ``plan`` is what the run has decided, the others are noted when they are done.
STEPS = ("plan", "archived", "kept", "staged", "dropped", "done")
#: The tables of a run and the time that decides about their rows.
TABLES = {"events": "ts", "metrics": "window_start"}


def retention_job(
    spark: SparkSession,
    events_path: str,
    metrics_path: str,
    archive_path: str,
    as_of: Moment,
    config: Retention = Retention(),
    log_path: str | None = None,
    until: str = "done",
) -> tuple[int, int]:
    """K1: archive expired metrics, then delete what has expired from both tables; how many rows went of each.

    Both tables have ``date`` as their first partition column. A run first notes what it is going to do: the cut-offs and
    the very files that hold expired rows, so that rows which arrive later are left for a later run. Then it

    * writes the expired metrics below ``<archive>/run=<n>/camera_id=/date=``,
    * writes the rows to keep of files that hold both sorts beside the log,
    * moves these into the table under hidden names, deletes the planned files, and shows the moved ones.

    Each step is noted when it is done, works on the planned files only and can be repeated until it is noted; an archive
    that has been noted is never touched again. A run that was stopped is finished first, under its own
    cut-offs, before a new one is planned. Rows to keep of partly expired files are hidden for the moment between the last two
    steps. One row per file with expired rows reaches the driver, which lists the files in any case.

    ``until`` ends the new run after an earlier step, so that expired rows may be archived now and deleted by the next call.
    """
    if until not in STEPS:
        raise ValueError(f"no step {until}")
    log = Journal(spark, log_path or archive_path.rstrip("/") + "_log")
    paths = {"events": events_path, "metrics": metrics_path}
    names, gone = log.names(), [0, 0]
    number = max((_number(n) for n in names), default=0)
    unfinished = [n for n in range(1, number + 1) if f"{_run(n)}-plan" in names and f"{_run(n)}-done" not in names]
    for n in unfinished:
        gone = [a + b for a, b in zip(gone, _finish(spark, log, n, archive_path), strict=True)]
    plan = _plan(spark, paths, as_of, config)
    if plan:
        if not log.put(f"{_run(number + 1)}-plan", plan):
            raise RuntimeError("another run of the retention job has just begun")
        gone = [a + b for a, b in zip(gone, _finish(spark, log, number + 1, archive_path, until), strict=True)]
    return gone[0], gone[1]


def read_archive(spark: SparkSession, archive_path: str, log_path: str | None = None) -> DataFrame:
    """The archived rows, without those of a run that has not finished its archive."""
    log = Journal(spark, log_path or archive_path.rstrip("/") + "_log")
    runs = [n for n in log.names() if n.endswith("-archived")]
    folders = [f"{archive_path}/run={_number(n)}" for n in runs if log.get(n)]
    if not folders:
        raise ValueError("nothing has been archived")
    return spark.read.option("basePath", archive_path).parquet(*folders).drop("run")


def _run(n: int) -> str:
    return f"run-{n:06}"


def _number(note: str) -> int:
    return int(note.split("-")[1])


def _cutoff(column: str, as_of: Moment, config: Retention) -> Column:
    age = F.make_dt_interval(hours=F.lit(config.events_hours)) if column == "ts" else F.make_dt_interval(days=F.lit(config.metrics_days))
    return moment(as_of) - age


def _plan(spark: SparkSession, paths: dict[str, str], as_of: Moment, config: Retention) -> dict:
    """The tables with expired rows: the cut-off, and of each file with such rows its path, and how many go and stay."""
    store, plan = Store(spark), {}
    for name, column in TABLES.items():
        cutoff = spark.range(1).select(F.unix_micros(_cutoff(column, as_of, config))).first()[0]
        if "_spark_metadata" in store.names(paths[name]):
            raise ValueError(f"{paths[name]} keeps a list of its files, from which none may go; write it with dated_by")
        if not store.files(paths[name]):
            continue
        rows = _expired(spark.read.parquet(paths[name]), column, cutoff, whole_dates=True)
        expired = F.count_if(F.col(column) < F.timestamp_micros(F.lit(cutoff)))
        files = rows.groupBy(F.col("_metadata.file_path").alias("file")).agg(
            expired.alias("gone"), (F.count(F.lit(1)) - expired).alias("stay")
        ).filter("gone > 0").collect()
        if files:
            listed = sorted([store.of_uri(r["file"]), r["gone"], r["stay"]] for r in files)
            plan[name] = {"path": store.qualified(paths[name]), "cutoff": cutoff, "files": listed}
    return plan


def _expired(table: DataFrame, column: str, cutoff: int, whole_dates: bool = False) -> DataFrame:
    border = F.timestamp_micros(F.lit(cutoff))
    rows = table.filter(F.col("date") <= F.to_date(border))
    return rows if whole_dates else rows.filter(F.col(column) < border)


def _finish(spark: SparkSession, log: Journal, n: int, archive_path: str, until: str = "done") -> tuple[int, int]:
    """Do what is left of a run, up to a step; how many rows of each table a finished run has deleted."""
    plan, done, store = log.get(f"{_run(n)}-plan"), set(log.names()), Store(spark)
    counts = [sum(f[1] for f in plan[name]["files"]) if name in plan else 0 for name in TABLES]
    rows_path = f"{log.path}/{_run(n)}-rows"
    kept = lambda: log.get(f"{_run(n)}-kept")
    work = {
        "plan": lambda: None,
        "archived": lambda: _archive(spark, store, plan, f"{archive_path}/run={n}"),
        "kept": lambda: _keep(spark, store, plan, rows_path),
        "staged": lambda: _stage(store, kept(), n),
        "dropped": lambda: _drop(store, plan),
        "done": lambda: _show(store, plan, kept(), n) or counts,
    }
    for step in STEPS:
        if f"{_run(n)}-{step}" not in done:
            log.put(f"{_run(n)}-{step}", work[step]())
        if step == until != "done":
            return 0, 0
    store.delete(rows_path)
    return counts[0], counts[1]


def _read(spark: SparkSession, table: dict, files: list) -> DataFrame:
    return spark.read.option("basePath", table["path"]).parquet(*[f[0] for f in files])


def _archive(spark: SparkSession, store: Store, plan: dict, folder: str) -> int:
    """Write the expired metrics of the planned files; whatever an earlier try has left goes first."""
    store.delete(folder)
    table = plan.get("metrics")
    if not table:
        return 0
    archive_metrics(_expired(_read(spark, table, table["files"]), "window_start", table["cutoff"]), folder)
    return sum(f[1] for f in table["files"])


def _keep(spark: SparkSession, store: Store, plan: dict, folder: str) -> list[list[str]]:
    """Write the rows to keep of partly expired files; [file, where in the table it belongs] of each file written."""
    store.delete(folder)
    out = []
    for name, table in plan.items():
        partly = [f for f in table["files"] if f[2]]
        if not partly:
            continue
        rows = _read(spark, table, partly).filter(F.col(TABLES[name]) >= F.timestamp_micros(F.lit(table["cutoff"])))
        below = partly[0][0].removeprefix(table["path"]).strip("/").split("/")[:-1]
        parts = [p.split("=")[0] for p in below if "=" in p]
        rows.write.partitionBy(*parts).parquet(f"{folder}/{name}")
        out += [[f"{folder}/{name}/{f}", f"{table['path']}/{f}"] for f in store.files(f"{folder}/{name}")]
    return out


def _names(target: str, n: int) -> tuple[str, str]:
    """The hidden and the visible name of a moved file."""
    folder, file = target.rsplit("/", 1)
    return f"{folder}/_{_run(n)}-{file}", f"{folder}/{_run(n)}-{file}"


def _stage(store: Store, kept: list[list[str]], n: int) -> None:
    for source, target in kept:
        hidden, _ = _names(target, n)
        if not store.rename(source, hidden) and not store.exists(hidden):
            raise FileNotFoundError(source)


def _drop(store: Store, plan: dict) -> None:
    for table in plan.values():
        for file, *_ in table["files"]:
            store.delete(file)


def _show(store: Store, plan: dict, kept: list[list[str]], n: int) -> None:
    for _, target in kept:
        hidden, shown = _names(target, n)
        if not store.rename(hidden, shown) and not store.exists(shown):
            raise FileNotFoundError(hidden)
    for table in plan.values():
        for folder in sorted({f[0].rsplit("/", 1)[0] for f in table["files"]}):
            while folder != table["path"] and "=" in folder.rsplit("/", 1)[1]:
                store.drop_if_empty(folder)
                folder = folder.rsplit("/", 1)[0]
