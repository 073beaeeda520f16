"""Ranked lexical search by presence masks.

Every item ranks all documents by the sum of its terms' scores. One pass over the texts keeps, for each document, its number
of terms and the frequencies of those terms that any item has. A second pass over this much smaller table searches:
within a block of documents, bitmaps of the items' terms are laid side by side, so that each document gets a mask of the
terms it holds; documents with one mask form a group. A mask can't score higher than the sum of its terms' best values in
the block. Masks are evaluated from the highest such maximum down, until the next one is below the score that the
item's last wanted rank has already reached; the rest is safely left out.

That score comes first from a sample of documents (any documents' scores are a bound from below) and rises within a task
as it goes on. A task hands on at most the wanted number of documents per item, and these are ranked per item.

Items are taken in blocks by a hash of their id, as many as keep a block's terms near BLOCK_TERMS, since the terms of a block
go to every task; each block reads the texts once. Scores are whole numbers, so that results don't depend on the order
of anything. Terms are told apart by 64-bit hashes of their bytes.

Defined results: NULL and texts without terms match nothing and aren't counted. Rows that repeat an id are documents of
their own, each with its rank; a NULL id comes after all others among equal scores. Rows of ``items`` with one id are one
item with the terms of all of them; a NULL id is an id. Items without terms, or whose terms occur nowhere, have no
rows, as has an empty table. Columns other than the ids and texts are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.llm.common import documents, stored
from roadpulse.llm.words import runs, word_spans

DEPTH = 50
#: Terms in a block of items, and terms times documents that a task lays out at once.
BLOCK_TERMS, CELLS = 50_000, 1 << 24
#: About so many documents give the first bounds from below.
SAMPLE_DOCS = 20_000
SEED = 13

#: Bytes outside terms: ASCII but for letters and digits.
_BETWEEN = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_NO_ID = np.iinfo(np.int64).max
_FOUND = "item long, doc_id long, score long"


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, its text's distinct terms) of each row."""
    for batch in batches:
        for begin, end, data, starts in runs(batch.column(1)):
            hashes, at = word_spans(data, starts, _BETWEEN)[:2]
            lists = [np.unique(hashes[at[i] : at[i + 1]]).view(np.int64) for i in range(end - begin)]
            ids = batch.column(0).slice(begin, end - begin)
            yield pa.RecordBatch.from_arrays([ids, pa.array(lists, pa.list_(pa.int64()))], ["id", "terms"])


def item_terms(items: DataFrame) -> DataFrame:
    """Stored (item_id, terms): one row per id, NULL included, with its distinct terms."""
    rows = items.select(F.col("item_id").cast("long"), F.col("text").cast("string")).mapInArrow(_terms, "id long, terms array<long>")
    terms = rows.select("id", F.explode("terms").alias("term")).distinct()
    return stored(terms.groupBy(F.col("id").alias("item_id")).agg(F.collect_list("term").alias("terms")), "items")


def _frequencies(vocabulary: np.ndarray):
    """For each document its number of terms, and which of the sorted ``vocabulary`` it holds how often."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end, data, starts in runs(batch.column(1)):
                hashes, at = word_spans(data, starts, _BETWEEN)[:2]
                row = np.repeat(np.arange(end - begin), np.diff(at))
                place = np.minimum(np.searchsorted(vocabulary, hashes), len(vocabulary) - 1)
                known = vocabulary[place] == hashes
                cells, tf = np.unique(row[known] * len(vocabulary) + place[known], return_counts=True)
                owner, term = np.divmod(cells, len(vocabulary))
                offsets = pa.array(np.searchsorted(owner, np.arange(end - begin + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (term, tf)]
                ids = batch.column(0).slice(begin, end - begin)
                yield pa.RecordBatch.from_arrays([ids, pa.array(np.diff(at)), *lists], ["doc_id", "n", "terms", "tf"])

    return count


class _Search:
    """The items' best documents among those seen so far."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, total: int, terms: int, depth: int, floors: np.ndarray):
        self.items, self.weights, self.total, self.terms, self.depth = items, weights, total, terms, depth
        self.floors = floors.copy()
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in items]
        self.evaluated = 0

    def values(self, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> np.ndarray:
        """Each term's value in each document, before its weight: an array of (terms of all items, documents)."""
        length = 50 + (50 * n * self.total) // self.terms
        out = np.zeros((len(self.weights), len(n)), np.int32)
        out[term, owner] = (1_000_000_000 * tf) // (1000 * tf + 20 * length[owner])
        return out

    def add(self, ids: np.ndarray, n: np.ndarray, owner: np.ndarray, term: np.ndarray, tf: np.ndarray) -> None:
        values = self.values(n, owner, term, tf)
        bitmaps, most = values > 0, values.max(1).astype(np.int64)
        for item, terms in enumerate(self.items):
            masks, group = presence_masks(bitmaps[terms])
            bounds = masks @ (self.weights[terms] * most[terms])
            order = np.argsort(-bounds, kind="stable")
            members = np.argsort(group, kind="stable")
            ends = np.cumsum(np.bincount(group, minlength=len(masks)))
            waiting: list[np.ndarray] = []
            for at, mask in enumerate(order):
                if bounds[mask] < max(1, self.floors[item]):
                    break
                waiting.append(members[ends[mask - 1] if mask else 0 : ends[mask]])
                if sum(map(len, waiting)) >= self.depth or at + 1 == len(order):
                    self._evaluate(item, np.concatenate(waiting), ids, values)
                    waiting = []
            if waiting:
                self._evaluate(item, np.concatenate(waiting), ids, values)

    def _evaluate(self, item: int, docs: np.ndarray, ids: np.ndarray, values: np.ndarray) -> None:
        self.evaluated += len(docs)
        terms = self.items[item]
        scores = self.weights[terms] @ values[np.ix_(terms, docs)].astype(np.int64)
        old_scores, old_ids = self.best[item]
        good = scores >= max(1, self.floors[item])
        scores, found = np.concatenate((old_scores, scores[good])), np.concatenate((old_ids, ids[docs[good]]))
        first = np.lexsort((found, -scores))[: self.depth]
        self.best[item] = scores[first], found[first]
        if len(first) == self.depth:
            self.floors[item] = max(self.floors[item], scores[first[-1]])


def presence_masks(bitmaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct columns of ``bitmaps`` (terms, documents) as rows of 0 and 1, and which of them each document has."""
    terms, docs = bitmaps.shape
    group, kinds = np.zeros(docs, np.int64), 1
    for begin in range(0, terms, 32):
        word = np.zeros(docs, np.int64)
        for bit, row in enumerate(bitmaps[begin : begin + 32]):
            word |= row.astype(np.int64) << bit
        distinct, part = np.unique(word, return_inverse=True)
        if kinds * len(distinct) >= 1 << 62:
            raise OverflowError("a block holds fewer documents than that")
        found, group = np.unique(group * len(distinct) + part, return_inverse=True)
        kinds = len(found)
    first = np.zeros(kinds, np.int64)
    first[group[::-1]] = np.arange(docs)[::-1]
    return bitmaps[:, first].T.astype(np.int64), group


def _searcher(items: list[np.ndarray], weights: np.ndarray, total: int, terms: int, depth: int, floors: np.ndarray):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = _Search(items, weights, total, terms, depth, floors)
        block = max(64, CELLS // max(1, len(weights)))
        for batch in batches:
            for begin in range(0, batch.num_rows, block):
                part = batch.slice(begin, block)
                ids = part.column(0).fill_null(_NO_ID).to_numpy()
                lists, tf = part.column(2), part.column(3).flatten().to_numpy().astype(np.int64)
                owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
                state.add(ids, part.column(1).to_numpy(), owner, lists.flatten().to_numpy(), tf)
        for item, (scores, ids) in enumerate(state.best):
            if len(scores):
                no_id = pa.array(ids, mask=ids == _NO_ID)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), item)), no_id, pa.array(scores)], ["item", "doc_id", "score"]
                )

    return search


def term_weight(total: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * total + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, items: list[np.ndarray], depth: int) -> DataFrame:
    """(item, doc_id, score): candidates for the first ``depth`` ranks of each of the items, given by their terms' hashes."""
    spark = docs.sparkSession
    vocabulary = np.unique(np.concatenate(items))
    places = [np.searchsorted(vocabulary, terms) for terms in items]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    counted = texts.mapInArrow(_frequencies(vocabulary), "doc_id long, n long, terms array<int>, tf array<int>")
    counted = stored(counted, "frequencies")
    total, terms = counted.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    matching = counted.filter(F.size("terms") > 0)
    holders = np.zeros(len(vocabulary), np.int64)
    for row in matching.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        holders[row["term"]] = row["count"]
    if not holders.any():
        return spark.createDataFrame([], _FOUND)
    weights = np.array([term_weight(total, int(df)) for df in holders], np.int64)
    sampled = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(max(1, total // SAMPLE_DOCS))) == 0
    floors = np.zeros(len(items), np.int64)
    first = _searcher(places, weights, total, terms, depth, floors)
    for row in _ranked(matching.filter(sampled).mapInArrow(first, _FOUND), "item", depth).filter(F.col("rank") == depth).collect():
        floors[row["item"]] = row["score"]
    return matching.mapInArrow(_searcher(places, weights, total, terms, depth, floors), _FOUND)


def _ranked(found: DataFrame, item: str, depth: int) -> DataFrame:
    order = W.partitionBy(item).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= depth)


def rank(docs: DataFrame, items: DataFrame, depth: int = DEPTH, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``depth`` documents of each item with the highest scores above 0."""
    spark = docs.sparkSession
    wanted = item_terms(items)
    blocks = math.ceil((wanted.agg(F.sum(F.size("terms"))).first()[0] or 0) / block_terms)
    out = None
    for block in range(blocks):
        mine = wanted.filter(F.pmod(F.xxhash64("item_id", F.lit(SEED)), F.lit(blocks)) == block).collect()
        if not mine:
            continue
        found = search_block(docs, [np.unique(np.array(r["terms"], np.int64).view(np.uint64)) for r in mine], depth)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(mine)], "item long, item_id long")
        part = _ranked(found, "item", depth).join(F.broadcast(names), "item")
        part = part.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        part = stored(part, "ranked") if blocks > 1 else part
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long") if out is None else out


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


SQL = r"""
WITH lowered AS (
  SELECT doc_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
d AS (SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(text, '[0-9a-z\x{80}-\x{10FFFF}]+') AS terms FROM lowered),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term
  FROM benchmark),
size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM d WHERE len(terms) > 0),
each AS (SELECT row_no, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM d),
tf AS (SELECT row_no, doc_id, n, term, count(*) AS tf FROM each
  WHERE term IN (SELECT term FROM i) GROUP BY row_no, doc_id, n, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM tf, size GROUP BY term),
score AS (
  SELECT item_id, row_no, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM tf JOIN i USING (term) JOIN w USING (term), size GROUP BY item_id, row_no, doc_id),
ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
"""
