"""H1-H3: the lane graph as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.plans.slices import dense_index

# Cameras per bucket when nodes are numbered.
CAMERAS_PER_BUCKET = 1000


def lane_nodes(lanes: DataFrame) -> DataFrame:
    """H1: number each (camera, lane) in the order of declaration; a repeated lane keeps its first place."""
    first = lanes.groupBy("camera_id", "lane_id").agg(F.min(F.struct("camera_pos", "lane_pos")).alias("at"))
    placed = first.select("camera_id", "lane_id", "at.*")
    bucket = F.floor(F.col("camera_pos") / CAMERAS_PER_BUCKET)
    return dense_index(placed, ["camera_pos", "lane_pos"], bucket, "node").select("node", "camera_id", "lane_id")


def lane_edges(nodes: DataFrame, lanes: DataFrame, cross: DataFrame) -> DataFrame:
    """H2: loops, neighbouring lanes of a camera and declared links between cameras, the latter two both ways."""
    loops = nodes.select(F.col("node").alias("src"), F.col("node").alias("dst"))
    order = W.partitionBy("camera_pos", "camera_id").orderBy("lane_pos")
    beside = lanes.select(
        F.col("camera_id").alias("from_camera"),
        F.col("lane_id").alias("from_lane"),
        F.col("camera_id").alias("to_camera"),
        F.lead("lane_id").over(order).alias("to_lane"),
    ).filter(F.col("to_lane").isNotNull())
    links = beside.unionByName(cross.select("from_camera", "from_lane", "to_camera", "to_lane"))
    one_way = _resolve(_resolve(links, nodes, "from", "src"), nodes, "to", "dst").select("src", "dst")
    back = one_way.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return loops.unionByName(one_way).unionByName(back).distinct()


def _resolve(links: DataFrame, nodes: DataFrame, end: str, name: str) -> DataFrame:
    """Node of one end; links to lanes outside the graph are skipped."""
    known = nodes.select(
        F.col("camera_id").alias(f"{end}_camera"), F.col("lane_id").alias(f"{end}_lane"), F.col("node").alias(name)
    )
    return links.join(known, [f"{end}_camera", f"{end}_lane"])


def require_edges(edges: DataFrame) -> DataFrame:
    """H2: a graph without edges is an error."""
    if edges.isEmpty():
        raise ValueError("the lane graph has no edges")
    return edges


def khop(edges: DataFrame, k: int) -> DataFrame:
    """H3: node pairs at a distance of at most ``k`` edges, with that distance.

    The result itself lists every pair. Means over a neighbourhood do not need it: see ``neighbour_means``.
    """
    if not 1 <= k <= 3:
        raise ValueError("k must be 1, 2 or 3")
    step = edges.filter(F.col("src") != F.col("dst")).select(F.col("src").alias("via"), F.col("dst").alias("next"))
    reached = edges.select("src", "dst", F.when(F.col("src") == F.col("dst"), 0).otherwise(1).alias("hops"))
    for _ in range(k - 1):
        further = reached.join(step, reached["dst"] == step["via"]).select(
            "src", F.col("next").alias("dst"), (F.col("hops") + 1).alias("hops")
        )
        reached = reached.unionByName(further).groupBy("src", "dst").agg(F.min("hops").alias("hops"))
    return reached


def neighbour_means(signal: DataFrame, edges: DataFrame, columns: list[str], hops: int) -> DataFrame:
    """H3 as message passing: after ``hops`` rounds a node holds means over its ``hops``-neighbourhood.

    Each round sends a node's values along its edges and averages what arrives at (time, node). Work grows with
    edges times hops, never with pairs of nodes, and the average combines on the map side.
    """
    current = signal.select("t_idx", "node", *columns)
    result = signal
    for hop in range(1, hops + 1):
        sent = current.join(edges, current["node"] == edges["src"]).select("t_idx", F.col("dst").alias("node"), *columns)
        current = sent.groupBy("t_idx", "node").agg(*[F.avg(c).alias(c) for c in columns])
        named = current.select("t_idx", "node", *[F.col(c).alias(f"{c}_hop{hop}") for c in columns])
        result = result.join(named, ["t_idx", "node"], "left")
    return result


def chebyshev_features(signal: DataFrame, edges: DataFrame, columns: list[str], order: int = 3, largest: float = 2.0) -> DataFrame:
    """H3, L1: Chebyshev polynomials 1 to ``order - 1`` of the scaled graph Laplacian, applied to each time's values.

    With the normalised adjacency A (1 / sqrt(deg * deg) along edges, loops left out) and the largest eigenvalue taken
    as ``largest``, the scaled Laplacian is S = (2 / largest) (1 - A) - 1, and T1 = S x, Tk = 2 S T(k-1) - T(k-2). A product
    with A sends values along edges and adds up what arrives, so that work grows with edges times order and no
    matrix is formed. ``signal`` has a row for every (t_idx, node); a node without neighbours receives nothing.
    """
    links = edges.filter(F.col("src") != F.col("dst")).select("src", "dst").distinct()
    degrees = links.groupBy("src").agg(F.count(F.lit(1)).alias("_degree"))
    far = degrees.select(F.col("src").alias("dst"), F.col("_degree").alias("_far"))
    weight = 1.0 / F.sqrt(F.col("_degree") * F.col("_far"))
    weighted = links.join(degrees, "src").join(far, "dst").select("src", "dst", weight.alias("_weight"))
    before, last = {c: f"_t0_{c}" for c in columns}, {c: f"_t1_{c}" for c in columns}
    keys = ["t_idx", "node"]

    def scaled(rows: DataFrame, names: list[str]) -> DataFrame:
        """(t_idx, node, _s_<name>): S times each of the columns."""
        sent = rows.join(weighted, rows["node"] == weighted["src"])
        arrived = sent.groupBy("t_idx", F.col("dst").alias("node")).agg(*[F.sum(F.col(c) * F.col("_weight")).alias(f"_a_{c}") for c in names])
        joined = rows.select(*keys, *names).join(arrived, keys, "left")
        value = lambda c: F.lit(2 / largest - 1) * F.col(c) - F.lit(2 / largest) * F.coalesce(f"_a_{c}", F.lit(0.0))
        return joined.select(*keys, *[value(c).alias(f"_s_{c}") for c in names])

    rows = signal.select(*keys, *[F.col(c).alias(before[c]) for c in columns])
    result = signal
    for k in range(1, order):
        source = before if k == 1 else last
        product = scaled(rows, [source[c] for c in columns])
        joined = rows.join(product, keys)
        new = {c: F.col(f"_s_{source[c]}") if k == 1 else 2 * F.col(f"_s_{last[c]}") - F.col(before[c]) for c in columns}
        kept = {c: F.col(before[c] if k == 1 else last[c]) for c in columns}
        rows = joined.select(*keys, *[kept[c].alias(before[c]) for c in columns], *[new[c].alias(last[c]) for c in columns])
        named = rows.select(*keys, *[F.col(last[c]).alias(f"{c}_cheb{k}") for c in columns])
        result = result.join(named, keys, "left")
    return result
