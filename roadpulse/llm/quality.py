"""Quality classifier by importance resampling.

Two generative models draw hashed n-grams: one fitted on texts labelled good (the target), one on all texts (raw). A
text's importance weight is the ratio of its probabilities under them; the seeded Gumbel top-k of the log weights is a
sample of raw texts distributed like the target. A text is accepted if its log weight per n-gram reaches a cut between
what good and bad texts reach.

N-grams are words and pairs of neighbouring words, hashed into 2**14 bins; a word that follows itself is one n-gram
whatever the word. Each text deals one share over its n-grams, so that one text, however long, says no more than
any other. Raw counts cover all rows. The target and the cut are fitted on a bounded sample, the TRAIN_ROWS
labelled rows that come first in a seeded order; rows whose crc32(id) mod 5 is 0 are left out for testing. Only counts
per bin and the sample's ids and scores reach the driver, all of fixed size. The cut is set on a quarter of the sample
that the target doesn't see (remainder 1), where the share of bad texts kept and GOOD_WEIGHT times the share of good
texts lost are least together.

Defined results: a text without words, or NULL, has log weight 0 and score 0 and is rejected only if the cut is above
0. Without good labels the weights are all 0, or there is no cut, and everything is accepted. Among equal keys the smaller id is sampled
first. An empty table gives an empty result. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from roadpulse.llm.common import documents, fold_of, labels, stored
from roadpulse.llm.words import hash_words, mixed, runs

BINS = 1 << 14
TRAIN_ROWS = 20_000
TEST_FOLDS = 5
#: Losing a share of the good texts is so many times as bad as keeping that share of the bad ones.
GOOD_WEIGHT = 10.0
#: Added to the number of n-grams, so that a few odd words don't condemn a short text.
SHRINK = 20.0
#: A text's share is 1 << SHARE_BITS, in whole numbers, so that sums don't depend on their order.
SHARE_BITS = 32
#: Added to a bin's target shares and to what the raw model expects there: without evidence the ratio is 1.
SMOOTH = 0.01
SAMPLE_SHARE = 0.5
SEED = 9
#: The top-k search ends with at most so many rows in question.
EXACT_ROWS = 20_000
RESULT = ("log_weight", "score", "accepted")

_REPEATED = np.uint64(0)


@dataclass(frozen=True)
class QualityModel:
    log_ratio: np.ndarray
    cut: float


def _ngrams(hashes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bin of each n-gram, and the text it belongs to."""
    text = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    first, second = hashes[:-1], hashes[1:]
    pairs = np.where(first == second, _REPEATED, mixed(first * np.uint64(3) + second))
    inside = text[:-1] == text[1:]
    bins = np.concatenate((hashes, pairs[inside])) % np.uint64(BINS)
    return bins.astype(np.int64), np.concatenate((text, text[:-1][inside]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(BINS, np.int64), np.zeros(BINS, np.int64)
    for batch in batches:
        good = np.array(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False)) == 1
        for begin, end, data, starts in runs(batch.column(0)):
            bins, text = _ngrams(*hash_words(data, starts))
            total = np.bincount(text, minlength=end - begin)
            cells, times = np.unique(text * BINS + bins, return_counts=True)
            text, bins = np.divmod(cells, BINS)
            share, wanted = (times << SHARE_BITS) // total[text], good[begin:end][text]
            np.add.at(raw, bins, share)
            np.add.at(target, bins[wanted], share[wanted])
    hit = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(raw[hit]), pa.array(target[hit])], ["bin", "raw", "target"])


def _scorer(log_ratio: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weight, total = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for begin, end, data, starts in runs(batch.column(batch.schema.get_field_index("text"))):
                bins, text = _ngrams(*hash_words(data, starts))
                weight[begin:end] = np.bincount(text, log_ratio[bins], end - begin)
                total[begin:end] = np.bincount(text, minlength=end - begin)
            columns = [*batch.columns, pa.array(weight), pa.array(weight / (total + SHRINK))]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "log_weight", "score"])

    return score


def training_rows(marks: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The labelled rows to learn from: at most ``rows``, so that they may be broadcast."""
    known = marks.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(fold_of(F.col("doc_id"), TEST_FOLDS) != 0).select("doc_id", F.col("quality").cast("int"))
    return known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id", "quality").limit(rows).dropDuplicates(["doc_id"])


def with_weights(docs: DataFrame, log_ratio: np.ndarray) -> DataFrame:
    """``docs`` with ``log_weight`` and ``score``, the log weight per n-gram."""
    docs = docs.drop(*RESULT)
    schema = T.StructType([*docs.schema.fields, T.StructField("log_weight", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return docs.mapInArrow(_scorer(log_ratio), schema)


def log_ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of how much likelier each bin is in the target, from the texts' shares in it."""
    raw, target = raw / (1 << SHARE_BITS), target / (1 << SHARE_BITS)
    expected = raw * (target.sum() / raw.sum())
    return np.log(target + SMOOTH) - np.log(expected + SMOOTH)


def best_cut(scores: np.ndarray, good: np.ndarray) -> float:
    """Where the shares of bad texts above and of good texts below, weighted, are least together.

    Of several such gaps the widest is taken, and the cut lies in it as far from the bad side as GOOD_WEIGHT says.
    Without good texts there is no cut; without bad ones it is the least score of a good text.
    """
    if not good.any():
        return float("-inf")
    if good.all():
        return float(scores.min())
    order = np.argsort(scores, kind="stable")
    scores, good = scores[order], good[order]
    below = np.concatenate(([0], np.cumsum(good))), np.concatenate(([0], np.cumsum(~good)))
    cost = GOOD_WEIGHT * below[0] / good.sum() - below[1] / (~good).sum()
    edges = np.concatenate(([scores[0]], scores, [scores[-1]]))
    gaps = np.diff(edges)
    gaps[0] = gaps[-1] = 0.0
    cost[1:-1][gaps[1:-1] == 0] = np.inf  # equal scores can't be parted
    best = np.flatnonzero(cost <= cost.min() + 1e-12)
    at = best[np.argmax(gaps[best])]
    return float(edges[at] + gaps[at] / (1 + GOOD_WEIGHT)) if gaps[at] else float("-inf") if at == 0 else float(edges[at])


def fit(docs: DataFrame, marks: DataFrame) -> QualityModel:
    sample = stored(training_rows(marks), "quality-sample")
    texts = docs.select("doc_id", F.col("text").cast("string"))
    for_cut = fold_of(F.col("doc_id"), TEST_FOLDS) == 1
    marked = texts.join(F.broadcast(sample.filter(~for_cut)), "doc_id", "left").select("text", "quality")
    counts = marked.mapInArrow(_count, "bin long, raw long, target long")
    raw, target = np.zeros(BINS), np.zeros(BINS)
    for row in counts.groupBy("bin").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[row["bin"]], target[row["bin"]] = row["raw"], row["target"]
    if not target.sum():
        return QualityModel(np.zeros(BINS), float("-inf"))
    log_ratio = log_ratios(raw, target)
    held = texts.join(F.broadcast(sample.filter(for_cut)), "doc_id").select("text", "quality")
    seen = with_weights(held, log_ratio).groupBy("quality", "score").count().orderBy("score", "quality").limit(TRAIN_ROWS).collect()
    scores = np.repeat([r["score"] for r in seen], [r["count"] for r in seen])
    good = np.repeat([r["quality"] == 1 for r in seen], [r["count"] for r in seen])
    return QualityModel(log_ratio, best_cut(scores, good.astype(bool)) if len(scores) else float("-inf"))


def classify(docs: DataFrame, model: QualityModel) -> DataFrame:
    """``docs`` with ``log_weight, score, accepted``."""
    return with_weights(docs, model.log_ratio).withColumn("accepted", F.col("score") >= F.lit(model.cut))


def _narrow(rows: DataFrame, column: str, k: int) -> tuple:
    """(low, high, left): of ``rows`` with the ``k`` largest values, all above ``high`` belong and ``left`` of those between.

    Each round counts the rows in 1,024 parts of the range. It ends with at most EXACT_ROWS rows, or one value.
    """
    low, high, left = *rows.agg(F.min(column), F.max(column)).first(), k
    whole = dict(rows.dtypes)[column] == "bigint"
    value = F.col(column).cast("decimal(38,0)") if whole else F.col(column)
    while low is not None and low < high:
        part = F.least(F.floor((value - F.lit(low)) * 1024 / F.lit(high - low)).cast("long"), F.lit(1023))
        counts = rows.filter(F.col(column).between(low, high)).groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("n"), F.min(column).alias("low"), F.max(column).alias("high")
        )
        parts = sorted(counts.collect(), key=lambda row: -row["part"])
        if sum(row["n"] for row in parts) <= EXACT_ROWS:
            break
        for row in parts:
            if left <= row["n"]:
                low, high = row["low"], row["high"]
                break
            left -= row["n"]
        else:
            break
    return low, high, left


def gumbel_top_k(scored: DataFrame, k: int, seed: int = SEED) -> DataFrame:
    """Stored ``scored`` (with ``doc_id`` and ``log_weight``) plus ``gumbel_key`` and ``sampled``, true for ``k`` rows.

    Rows that share the k-th largest key are told apart by their id, and copies of one id by their place in the stored
    table. The border is found by counting in ranges, so that no more than EXACT_ROWS rows are put in order.
    """
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit((1 << 52) - 1)) + 1) / F.lit(float(1 << 52))
    smaller_first = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(-(1 << 63)))
    key = F.col("log_weight") - F.log(-F.log(uniform))
    ranked = scored.withColumns({"gumbel_key": key, "_by_id": smaller_first, "_row": F.monotonically_increasing_id()})
    keyed = stored(ranked, "keys")
    left, sure, edge = k, F.lit(False), F.lit(True)
    for column in ("gumbel_key", "_by_id", "_row"):
        low, high, left = _narrow(keyed.filter(edge), column, left)
        if low is None:
            break
        sure, edge = sure | (edge & (F.col(column) > high)), edge & F.col(column).between(low, high)
        if low < high:
            break
    order = W.orderBy(F.col("gumbel_key").desc(), F.col("_by_id").desc(), F.col("_row").desc())
    first = keyed.filter(edge).withColumn("sampled", F.row_number().over(order) <= left)
    return first.unionByName(keyed.filter(~edge).withColumn("sampled", sure)).drop("_by_id", "_row")


def resample(docs: DataFrame, marks: DataFrame, share: float = SAMPLE_SHARE) -> DataFrame:
    """(doc_id, log_weight, score, accepted, gumbel_key, sampled): ``share`` of the accepted rows are sampled."""
    scored = stored(classify(docs.select("doc_id", "text"), fit(docs, marks)).drop("text"), "scores")
    accepted = scored.filter("accepted")
    sampled = gumbel_top_k(accepted, round(share * accepted.count()))
    rest = scored.filter(~F.col("accepted")).withColumns({"gumbel_key": F.lit(None).cast("double"), "sampled": F.lit(False)})
    return sampled.unionByName(rest)


def op9_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(documents(spark, sf_dir), labels(spark, sf_dir))
