"""Corpus pipeline: quality filter, exact dedup, near-dedup, mixing, tokenizing.

Each stage takes (spark, docs, sf_dir) and returns what it keeps; ``run`` writes that as Parquet in the shared folder,
reads it again for the next stage, and deletes what the stage alone has needed. All stages but the last return the columns
of ``documents``, whatever they are named. Texts are
shuffled once, when the mix is joined; ids that dedup drops go through a Bloom filter, so that nearly all other
documents pass straight through.

After mixing, a document occurs as often as the mix takes it. The last stage returns one row per occurrence with the
number of its tokens and digests of the ids and of the decoded text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.common import documents, labels, stored, without
from roadpulse.llm.exact_dedup import RESULT, exact_dedup
from roadpulse.llm.mixing import mix
from roadpulse.llm.near_dedup import near_dedup
from roadpulse.llm.pieces import default_model, round_trip
from roadpulse.llm.quality import RESULT as QUALITY
from roadpulse.llm.quality import classify, fit
from roadpulse.llm.queries import ORACLES
from roadpulse.llm.queries import QUERIES as OPERATORS
from roadpulse.session import folders_made, keep_last


def _own_names(docs: DataFrame, names: tuple[str, ...], judge: Callable[[DataFrame], DataFrame], keep: str) -> DataFrame:
    """The rows of ``docs`` that ``judge`` marks to keep; columns that are named like its result get out of its way."""
    aside = {c: f"_own_{i}_{c}" for i, c in enumerate(docs.columns) if c in names}
    kept = judge(docs.withColumnsRenamed(aside)).filter(keep).drop(*names)
    return kept.withColumnsRenamed({there: c for c, there in aside.items()}).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = fit(docs, labels(spark, sf_dir))
    return _own_names(docs, QUALITY, lambda rows: classify(rows, model), "accepted")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, that with the largest id."""
    return _own_names(docs, RESULT, exact_dedup, "kept")


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component, that with the smallest id."""
    dropped = stored(near_dedup(docs).filter(~F.col("kept")).select("doc_id"), "dropped")
    return without(docs, dropped, "doc_id")


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix(docs).groupBy("doc_id").agg(F.max("copies").alias("_copies")).filter("_copies > 0")
    taken = taken.withColumnRenamed("doc_id", "_id")
    times = F.explode(F.sequence(F.lit(1).cast("long"), "_copies")).alias("_time")
    return docs.join(taken, F.col("doc_id").eqNullSafe(F.col("_id"))).select(*docs.columns, times).drop("_time")


def tokenizing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of each row."""
    return round_trip(docs, default_model())


STAGES = [
    ("quality", quality_stage),
    ("exact_dedup", exact_stage),
    ("near_dedup", near_stage),
    ("mixing", mixing_stage),
    ("tokenizing", tokenizing_stage),
]
#: Near-dedup, hashed models and tokenizing are beyond SQL; tests/llm checks the stages by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, mark = documents(spark, sf_dir), folders_made()
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        keep_last(mark)
    return docs


QUERIES = {**OPERATORS, "pipeline": run}
SQL = dict(ORACLES)
