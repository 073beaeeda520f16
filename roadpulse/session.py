"""Session settings and the shared folder for checkpoints and written tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid

from pyspark.sql import SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def prepare(spark: SparkSession) -> SparkSession:
    """Set what the operators rely on: UTC time, adaptive plans, RocksDB state.

    Stages whose generated methods exceed what the JVM compiles (8,000 bytes of bytecode) would run interpreted; they run
    without whole-stage code instead, whose methods are small.
    """
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "8000")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``.

    Only a local session may go without that setting; on a cluster a machine-local folder would be lost with
    its executor, so an unset value is an error there.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="roadpulse-")
        spark.conf.set("spark.checkpoint.dir", root)
    folder = os.path.join(root, f"{purpose}-{uuid.uuid4().hex}")
    if not _made:
        atexit.register(drop_intermediates)
    _made.append((spark, folder))
    return folder


_made: list[tuple[SparkSession, str]] = []


def folders_made() -> int:
    """How many fresh folders there are; a mark for ``keep_last``."""
    return len(_made)


def keep_last(mark: int) -> None:
    """Delete the fresh folders made since ``mark`` but for the last, once that has been written and needs the others no more."""
    for spark, folder in _made[mark:-1]:
        drop_folder(spark, folder)
    _made[mark:] = _made[-1:] if len(_made) > mark else []


def drop_folder(spark: SparkSession, path: str) -> bool:
    """Delete a folder in whatever store it is; whether there was one."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def drop_intermediates() -> None:
    """Delete what this process wrote to the shared folder. Runs at its end, if the session still runs then."""
    while _made:
        spark, folder = _made.pop()
        with contextlib.suppress(Exception):  # the session is gone
            drop_folder(spark, folder)
