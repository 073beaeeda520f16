"""Mixing sources to target weights by capped water-filling.

A source's target is its weight's share of all words, at most ``max_epochs`` times what it has. What a capped source
can't take goes to the others by weight, again and again, until no target is above its cap. Each document is then
taken as many whole times as its source's target holds the source, and the documents that come first in a seeded
order once more, until the rest of the target is filled: each source is off by half a document at most.

The order is cut into 4,096 buckets of the seeded hash. Sums per (source, bucket) say how much lies before a bucket,
so that rows are ordered within a bucket only, and a source that owns a third of all rows is spread over them.

Defined results: a NULL source is a source of its own, last in order; a NULL or blank text has size 0 and takes 0;
if all sizes are 0, so are all targets. Rows with equal id and size are interchangeable. An empty table gives an empty
result. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.llm.common import WORD, documents, stored
from roadpulse.plans.slices import dense_index

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
SEED = "mix-1"
KEY = "_source"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _draw(doc_id: Column, seed: str) -> Column:
    """52 seeded bits of the id."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def water_level(sources: DataFrame) -> float:
    """The words per unit of weight at which capped and open targets together make all words.

    ``sources`` is stored and has ``weight`` (long), ``source_size`` and ``cap``. Every round raises the level, and a
    capped source stays capped, so that it ends when a round caps no more. Only sums reach the driver.
    """
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level, capped = 0.0, -1
    while True:
        over = F.col("cap") < F.col("weight") * F.lit(level) if capped >= 0 else F.lit(False)
        n, taken, weight = sources.agg(
            F.count_if(over),
            F.coalesce(F.sum(F.when(over, F.col("cap"))), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
        ).first()
        if n == capped or not weight:
            return level
        level, capped = float(total - taken) / float(weight), n


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source of the stored (source, _source, size): ``source_size, weight, cap, target``."""
    sums = sized.groupBy(KEY, "source").agg(F.sum("size").alias("source_size"))
    first = F.struct(F.col("source").isNull().alias("last"), F.coalesce(F.substring("source", 1, 4), F.lit("")).alias("p"))
    ranked = dense_index(stored(sums, "sources"), ["source"], first, "rank")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")).cast("long")
    sources = stored(ranked.withColumns({"weight": weight, "cap": F.col("source_size") * F.lit(max_epochs)}), "weights")
    share = F.col("weight") * F.lit(water_level(sources))
    return sources.withColumn("target", F.least(F.col("cap").cast("double"), share))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every row of ``docs``."""
    key = F.when(F.col("source").isNull(), "n").otherwise(F.concat(F.lit("s"), "source"))
    sized = stored(
        docs.select("doc_id", "source", words_in(F.col("text")).alias("size"))
        .withColumns({KEY: key, "_draw": _draw(F.col("doc_id"), seed)})
        .withColumn("_bucket", F.shiftright("_draw", 40)),
        "sizes",
    )
    before = W.partitionBy(KEY).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = sized.groupBy(KEY, "_bucket").agg(F.sum("size").alias("_words"))
    buckets = buckets.withColumn("_before", F.coalesce(F.sum("_words").over(before), F.lit(0))).drop("_words")
    targets = source_targets(sized, weights, max_epochs).select(KEY, "source_size", "target")
    along = W.partitionBy(KEY, "_bucket").orderBy("_draw", "doc_id", "size").rowsBetween(W.unboundedPreceding, 0)
    placed = sized.join(buckets.join(targets, KEY), [KEY, "_bucket"])
    whole = F.coalesce(F.floor(F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))), F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    middle = F.col("_before") + F.sum("size").over(along) - F.col("size") / F.lit(2.0)
    copies = (whole + (middle < rest).cast("long")).cast("long")
    return placed.withColumn("copies", copies).select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT AS draw FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (3 * sum(size))::BIGINT AS cap,
    ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER w AS k, sum(cap) OVER w - cap AS capped, sum(weight) OVER () - sum(weight) OVER w + weight
    AS open, sum(source_size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY cap / weight, weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
l AS (
  SELECT arg_min((total - capped)::DOUBLE / open::DOUBLE, k) AS level FROM o
  WHERE cap::DOUBLE >= weight::DOUBLE * ((total - capped)::DOUBLE / open::DOUBLE)),
t AS (SELECT source, source_size, least(cap::DOUBLE, weight::DOUBLE * (SELECT level FROM l)) AS target FROM s),
m AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
    sum(size) OVER (PARTITION BY d.source ORDER BY draw, doc_id, size ROWS UNBOUNDED PRECEDING) - size / 2.0::DOUBLE AS mid
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
  ((whole + CASE WHEN mid < target - whole * source_size THEN 1 ELSE 0 END) * size)::BIGINT AS taken FROM m
"""
