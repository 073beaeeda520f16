"""Exact dedup with two passes over Bloom filters.

Pass 1 counts how often each cell of a filter is hit and keeps the cells hit at least twice. Pass 2 probes that
filter: a text whose cells were not all hit twice has no copy and passes straight through; only the others are
shuffled, by their full SHA-256. A filter that is too small for the input lets more rows through to the shuffle and
never changes the result.

Defined results: a NULL text counts as empty, and all empty texts are copies of each other. Rows that repeat both id
and text are one document: all of them carry the same flags. A NULL id is never the largest while another id exists.
An empty table gives an empty result. Columns of the input other than ``doc_id`` and ``text`` pass unchanged, unless
they are named like a result column, which replaces them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.common import (
    ascii_lower, bloom_filter, cells_of, documents, filter_bits, join_groups, might_contain, stored,
)

RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def with_digest(docs: DataFrame) -> DataFrame:
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    return docs.drop(*RESULT).withColumn("text_sha256", F.sha2(text.cast("binary"), 256))


def digests(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, text_sha256) of every row."""
    return stored(with_digest(docs).select("doc_id", "text_sha256"), "digests")


def mark_copies(rows: DataFrame, hashes: DataFrame) -> DataFrame:
    """Add ``keep_id, group_size, kept`` to ``rows``, whose digests are stored in ``hashes``."""
    count = hashes.count()
    bits = filter_bits(count)
    digest = F.col("text_sha256")
    hits = hashes.select(F.explode(F.array(*cells_of(digest, bits))).alias("cell")).groupBy("cell").count()
    words = bloom_filter(hits.filter("count > 1").select("cell"), bits)
    repeated = might_contain(words, digest, bits)
    groups = (
        hashes.filter(repeated)
        .groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    )
    single = rows.filter(~repeated).withColumns({"keep_id": F.col("doc_id"), "group_size": F.lit(1).cast("long")})
    several = join_groups(rows.filter(repeated), stored(groups, "groups"), "text_sha256", "group_size", count)
    marked = single.unionByName(several.select(*single.columns))
    return marked.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """All rows of ``docs`` with ``keep_id, group_size, kept, text_sha256``."""
    return mark_copies(with_digest(docs), digests(docs))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashes = digests(documents(spark, sf_dir).select("doc_id", "text"))
    return mark_copies(hashes, hashes).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
WITH h AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'))
    AS text_sha256 FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM h GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256
FROM h JOIN g USING (text_sha256)
"""
