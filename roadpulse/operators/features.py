"""Features, the dense lane-by-time signal and sliding samples."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.config import PI, ForecastWindow
from roadpulse.functions.rules import clamp, level_idx, level_prob
from roadpulse.plans.slices import COPY, SLICE, dense_index, drop_copies, overlap

FEATURES = (
    "vehicle_count",
    "avg_speed_kmh",
    "stopped_ratio",
    "congestion_score",
    "hour_sin",
    "hour_cos",
    "dow_sin",
    "dow_cos",
)

#: Rows of a tile of the dense grid, and partitions that the tiles are dealt to at most.
TILE_ROWS, MOST_PARTITIONS = 1 << 18, 10_000


def _cycle(position: Column, length: int) -> Column:
    return F.lit(2 * PI) * position / F.lit(length)


def features(df: DataFrame, window: ForecastWindow = ForecastWindow()) -> DataFrame:
    """values clipped and scaled to [0, 1], the time of day and the weekday as points on a circle."""
    at = F.col("window_start")
    hour = F.hour(at) + F.minute(at) / 60
    known = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    count_max, speed_max = float(window.vehicle_count_max), float(window.speed_max_kmh)
    return df.select(
        "camera_id",
        "lane_id",
        "window_start",
        (clamp(known("vehicle_count"), 0.0, count_max) / count_max).alias("vehicle_count"),
        (clamp(known("avg_speed_kmh"), 0.0, speed_max) / speed_max).alias("avg_speed_kmh"),
        clamp(known("stopped_ratio")).alias("stopped_ratio"),
        clamp(known("congestion_score")).alias("congestion_score"),
        F.sin(_cycle(hour, 24)).alias("hour_sin"),
        F.cos(_cycle(hour, 24)).alias("hour_cos"),
        F.sin(_cycle(F.weekday(at), 7)).alias("dow_sin"),
        F.cos(_cycle(F.weekday(at), 7)).alias("dow_cos"),
        level_idx(F.col("congestion_level")).alias("congestion_level_idx"),
    )


def align_to_graph(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of lanes that belong to the graph, with their node index."""
    return df.join(nodes.select("camera_id", "lane_id", "node"), ["camera_id", "lane_id"])


def recent_times(df: DataFrame, t_in: int) -> DataFrame:
    """F8: the newest ``t_in`` distinct times; nothing when there are fewer."""
    newest = df.select("window_start").distinct().orderBy(F.desc("window_start")).limit(t_in)
    enough = newest.agg((F.count(F.lit(1)) >= t_in).alias("enough")).scalar()
    return newest.filter(enough)


def recent_input(df: DataFrame, nodes: DataFrame, t_in: int) -> DataFrame:
    """The newest ``t_in`` times of the dense signal; a lane silent at one of them counts as zero."""
    recent = df.join(recent_times(df, t_in), "window_start", "left_semi")
    return dense_signal(recent, nodes)


def dense_signal(df: DataFrame, nodes: DataFrame, tile_rows: int = TILE_ROWS) -> DataFrame:
    """one row per (time, node), zero where a lane has no row.

    The grid is cut into tiles, a run of times by a run of the node numbers 0..n-1 that the graph has assigned without
    gaps, and dealt out by tile before it is expanded: no task holds a date, however many nodes there are. The values
    are attached by an equi-join on (time, node).
    """
    times = dense_index(df.select("window_start").distinct(), ["window_start"], F.to_date("window_start"), "t_idx")
    count = nodes.count()
    side = max(1, math.isqrt(tile_rows))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.lit((count - 1) // side).cast("long"))).alias("_block")
    tiles = times.select("t_idx", "window_start", F.floor(F.col("t_idx") / side).alias("_run"), blocks) if count else None
    if tiles is None:
        grid = times.select("t_idx", "window_start", F.lit(None).cast("long").alias("node")).filter(F.lit(False))
    else:
        # As many partitions as there are tiles, up to a bound: by size alone, these small rows would stay together.
        amount = -(-times.count() // side) * (-(-count // side))
        dealt = tiles.repartition(max(1, min(amount, MOST_PARTITIONS)), "_run", "_block")
        first = F.col("_block") * side
        node = F.explode(F.sequence(first, F.least(first + side, F.lit(count)) - 1)).alias("node")
        grid = dealt.select("t_idx", "window_start", node)
    values = align_to_graph(df, nodes).drop("camera_id", "lane_id")
    filled = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FEATURES]
    idx = F.coalesce("congestion_level_idx", F.lit(0))
    return grid.join(values, ["window_start", "node"], "left").select(
        "t_idx",
        "window_start",
        "node",
        *filled,
        idx.alias("congestion_level_idx"),
        level_prob(idx).alias("congestion_prob"),
    )


def sliding_samples(
    dense: DataFrame, t_in: int, t_out: int, slice_steps: int | None = None, check: bool = True
) -> DataFrame:
    """for each start s the inputs of steps [s, s+t_in) and the targets of the ``t_out`` steps after them.

    A sample looks ``t_in + t_out - 1`` steps ahead, so a node's series is cut into slices of many samples and the
    first steps of a slice are copied into the one before. With ``check`` too short a series is an error.
    """
    length = t_in + t_out
    width = slice_steps or length * 20
    if check:
        _require_length(dense, length)
    placed = overlap(dense, F.col("t_idx"), width, after=length - 1)
    frame = W.partitionBy("node", SLICE).orderBy("t_idx").rowsBetween(0, length - 1)
    row = F.struct(*FEATURES, "congestion_level_idx", "congestion_prob")
    framed = placed.select("node", "t_idx", COPY, SLICE, F.collect_list(row).over(frame).alias("frame"))
    whole = drop_copies(framed).filter(F.size("frame") == length)
    target = F.slice("frame", t_in + 1, t_out)
    return whole.select(
        "node",
        F.col("t_idx").alias("start"),
        F.transform(F.slice("frame", 1, t_in), lambda r: F.array(*[r[c] for c in FEATURES])).alias("x"),
        F.transform(target, lambda r: r["vehicle_count"]).alias("y_vehicle_count"),
        F.transform(target, lambda r: r["congestion_prob"]).alias("y_congestion_prob"),
        F.transform(target, lambda r: r["congestion_level_idx"]).alias("y_congestion_level"),
    )


def _require_length(dense: DataFrame, length: int) -> None:
    steps = dense.select(F.max("t_idx")).first()[0]
    if steps is None or steps + 1 < length:
        raise ValueError(f"the series has {0 if steps is None else steps + 1} steps, at least {length} are needed")
