"""Helpers that several operators share: stored intermediates, Bloom filters as columns, joins that survive hot keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.session import shared_folder

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Words are runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
#: A Bloom filter never has more bits than this (16 MB), so that it may be sent to every task at any input size.
MAX_FILTER_BITS = 1 << 27
MIN_FILTER_BITS = 1 << 16
#: A group with more than this share of the rows is hot. There are at most 1,000 such groups, a bound that lets their
#: summaries be broadcast.
HOT_SHARE = 0.001


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again: computed once, and safe from lost executors."""
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else. ``lower`` is the same, and much faster, where the text is pure ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))


def filter_bits(items: int) -> int:
    """Bits for so many items: 16 each, within the bounds."""
    wanted = 1 << max(1, math.ceil(math.log2(max(1, items) * 16)))
    return min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, wanted))


def cells_of(item: Column, bits: int, probes: int = 2) -> list[Column]:
    return [F.pmod(F.xxhash64(item, F.lit(i)), F.lit(bits)) for i in range(probes)]


def bloom_filter(cells: DataFrame, bits: int) -> Column:
    """The rows of ``cells`` (one long column, ``cell``) as an array of 64-bit words in one scalar subquery."""
    spark = cells.sparkSession
    mask = F.expr("shiftleft(1L, cast(cell % 64 as int))")
    words = cells.groupBy(F.expr("cell div 64").alias("id")).agg(F.bit_or(mask).alias("word"))
    dense = spark.range(0, bits // 64, 1, 1).join(words, "id", "left")
    rows = F.array_sort(F.collect_list(F.struct("id", F.coalesce("word", F.lit(0)).alias("word"))))
    one = dense.agg(F.transform(rows, lambda row: row["word"]).alias("words"))
    return stored(one, "bloom").scalar()


def might_contain(words: Column, item: Column, bits: int, probes: int = 2) -> Column:
    found = F.lit(True)
    for cell in cells_of(item, bits, probes):
        word = F.element_at(words, (F.shiftright(cell, 6) + 1).cast("int"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), (cell % 64).cast("int"))
        found = found & (word.bitwiseAND(bit) != 0)
    return F.coalesce(found, F.lit(True))


def id_filter(ids: DataFrame, column: str) -> tuple[Column, int]:
    """A Bloom filter over a stored column of ids."""
    bits = filter_bits(ids.count())
    cells = ids.select(F.explode(F.array(*cells_of(F.col(column), bits))).alias("cell")).distinct()
    return bloom_filter(cells, bits), bits


def pick(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` occurs in the stored ``ids``; only likely ones are shuffled."""
    words, bits = id_filter(ids, column)
    return df.filter(might_contain(words, F.col(column), bits)).join(ids.select(column).distinct(), column, "left_semi")


def without(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows of ``df`` whose ``column`` doesn't occur in the stored ``ids``; most of them are not shuffled."""
    words, bits = id_filter(ids, column)
    likely = might_contain(words, F.col(column), bits)
    checked = df.filter(likely).join(ids.select(column).distinct(), column, "left_anti")
    return df.filter(~likely).unionByName(checked.select(*df.columns))


def join_groups(df: DataFrame, groups: DataFrame, key: str, size: str, rows: int) -> DataFrame:
    """Join one-row-per-key ``groups`` (stored) to ``df``; keys that own many rows don't meet in one task.

    Groups above HOT_SHARE of ``rows``, the number of rows in ``df``, are broadcast: there are 1 / HOT_SHARE at most.
    """
    bound = max(1000.0, rows * HOT_SHARE)
    hot = F.broadcast(groups.filter(F.col(size) > bound))
    near = df.join(hot, key)
    far = df.join(hot.select(key), key, "left_anti").join(groups.filter(F.col(size) <= bound), key)
    return near.unionByName(far)
