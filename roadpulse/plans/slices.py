"""Ordered work per key without holding a key's whole history in one task.

A window function partitioned by a key alone puts everything that key ever produced into one task, and one camera
or vehicle may own a third of all rows. The helpers here cut the order into slices and partition by
``(key, slice)`` instead. What a slice needs from its neighbours reaches it in one of two exact ways:

* *overlap* - when only a bounded stretch before or after a row matters, the rows near a slice border are copied
  into the neighbouring slice and dropped again after the window function;
* *carry* - when the whole past matters, each slice is reduced to one summary row, the summaries are accumulated
  per key (one row per slice, not per record) and joined back on ``(key, slice)``.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

SLICE = "_slice"
COPY = "_is_copy"
MICROS = 1_000_000


def slice_start(position: Column, width: int) -> Column:
    """Start of the slice that ``position`` (a whole number) falls into."""
    return position - F.pmod(position, F.lit(width))


def time_slice(moment: Column, seconds: int) -> Column:
    return slice_start(F.unix_micros(moment), seconds * MICROS)


def overlap(df: DataFrame, position: Column, width: int, before: int = 0, after: int = 0) -> DataFrame:
    """Put each row into its slice, and copy it to the slices whose rows look back or ahead to it.

    ``before`` and ``after`` say how far a row looks, in units of ``position``. Both must fit into one slice.
    """
    if max(before, after) > width:
        raise ValueError("a row may not look further than one slice")
    own = slice_start(position, width)
    homes = [F.struct(own.alias(SLICE), F.lit(False).alias(COPY))]
    if before:
        reaches_next = own + F.lit(width) - position <= F.lit(before)
        homes.append(F.when(reaches_next, F.struct((own + F.lit(width)).alias(SLICE), F.lit(True).alias(COPY))))
    if after:
        reaches_previous = position - own < F.lit(after)
        homes.append(F.when(reaches_previous, F.struct((own - F.lit(width)).alias(SLICE), F.lit(True).alias(COPY))))
    placed = df.withColumn("_home", F.explode(F.array_compact(F.array(*homes))))
    return placed.select("*", f"_home.{SLICE}", f"_home.{COPY}").drop("_home")


def drop_copies(df: DataFrame) -> DataFrame:
    return df.filter(~F.col(COPY)).drop(COPY, SLICE)


def carry(
    df: DataFrame,
    keys: list[str],
    summary: dict[str, Column],
    carried: dict[str, Column],
    prepared: dict[str, Column] | None = None,
) -> DataFrame:
    """Join to each row what the other slices of its key say.

    ``summary`` holds the aggregates that reduce a slice to one row; ``carried`` holds expressions over those names,
    evaluated along the slices of a key (windows ``along``, ``past`` and ``future``). ``prepared`` adds columns in
    between, for a carried window that needs the result of another one. ``df`` is read twice: store it first if it is
    costly to compute. NULL keys are one value.
    """
    by_slice = df.groupBy(*keys, SLICE).agg(*[agg.alias(name) for name, agg in summary.items()])
    by_slice = by_slice.withColumns(prepared or {})
    names = [*keys, SLICE]
    theirs = [F.col(name).alias(f"_of_{name}") for name in names]
    accumulated = by_slice.select(*theirs, *[expr.alias(name) for name, expr in carried.items()])
    same = reduce(and_, [F.col(name).eqNullSafe(F.col(f"_of_{name}")) for name in names])
    return df.join(accumulated, same).drop(*[f"_of_{name}" for name in names])


def along(keys: list[str]):
    """The slices of a key in order."""
    return W.partitionBy(*keys).orderBy(SLICE)


def past(keys: list[str]):
    """All slices of a key before the current one."""
    return along(keys).rowsBetween(W.unboundedPreceding, -1)


def future(keys: list[str]):
    """All slices of a key after the current one."""
    return along(keys).rowsBetween(1, W.unboundedFollowing)


def dense_index(df: DataFrame, order: list[str], bucket: Column, name: str) -> DataFrame:
    """Number distinct rows 0, 1, 2, ... in ``order``.

    ``bucket`` must rise with the order. Rows are numbered within their bucket and moved by the number of rows in
    earlier buckets, so the only unpartitioned window runs over one row per bucket.
    """
    bucketed = df.withColumn("_bucket", bucket)
    sizes = bucketed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_bucket", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    place = F.row_number().over(W.partitionBy("_bucket").orderBy(*order)) - 1
    return bucketed.join(offsets, "_bucket").withColumn(name, F.col("_offset") + place).drop("_bucket", "_offset")
