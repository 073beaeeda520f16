"""MinHash near-dedup with sequential Bayesian verification.

1. Each text becomes a set of five-word shingles and a signature of 128 minima. Texts with the same words collapse to
   their smallest id; everything else works on these representatives.
2. Signatures are cut into 32 bands of 4. In each bucket of equal bands every document is paired with the bucket's
   smallest: as many pairs as rows, never all pairs.
3. Signature batches of a pair are compared one after another. With a uniform prior, m equal minima out of n put the
   posterior probability of similarity >= t at P(Bin(n + 1, t) <= m); a pair is pruned as soon as that falls below
   MISS, the chosen miss probability. Of each document's surviving pairs the likeliest is verified on the full sets,
   and the links give first components: most of a tight group is then one component.
4. What is left are pairs in a bucket whose components differ. Small buckets list them. For a large bucket, the
   documents outside its hub's component are compared with all its documents, in blocks of a bounded size, one task
   per pair of blocks, by the same batches and then on the full sets; only links leave the task.
5. The components of all links are the result.

A pair at the threshold shares no band with probability (1 - 0.75^4)^32 = 5e-6.

Defined results: a text without words, or NULL, has no shingles and is a component of its own. Rows with one id are
one document. An empty table gives an empty result. Links are exact: no hash collisions but those of 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.common import documents, join_groups, pick, stored
from roadpulse.llm.components import components
from roadpulse.llm.words import hash_words, mixed, runs, shingles

SHINGLE = 5
BANDS, ROWS = 32, 4
MINIMA = BANDS * ROWS
BATCH = 32
PERCENT = 75
MISS = 1e-4
#: Buckets up to this size list their pairs; larger ones are compared in blocks.
LISTED = 32
#: A block holds about so many documents and so many shingles.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 500_000

_RNG = np.random.default_rng(8)
_XOR = _RNG.integers(0, 1 << 32, MINIMA, dtype=np.uint64).astype(np.uint32)
_ODD = (_RNG.integers(0, 1 << 31, MINIMA, dtype=np.uint64) * 2 + 1).astype(np.uint32)
_SIGNED = "doc_id long, words binary, n_shingles long, signature binary"


def least_matches(seen: int, percent: int = PERCENT, miss: float = MISS) -> int:
    """The fewest equal minima out of ``seen`` that keep a pair: P(similarity >= threshold) is at least ``miss``."""
    t, below = percent / 100, 0.0
    for m in range(seen + 1):
        below += math.comb(seen + 1, m) * t**m * (1 - t) ** (seen + 1 - m)
        if below >= miss:
            return m
    return seen


_LEAST = [(n, least_matches(n)) for n in range(BATCH, MINIMA + 1, BATCH)]


def _word_runs(batch: pa.RecordBatch) -> Iterator[tuple]:
    for begin, end, data, starts in runs(batch.column(1)):
        yield batch.column(0).slice(begin, end - begin), *hash_words(data, starts)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, hashes, starts in _word_runs(batch):
            sets, at = shingles(hashes, starts, SHINGLE)
            full = np.flatnonzero(np.diff(at))
            minima = np.empty((len(full), MINIMA), np.uint32)
            digests = np.empty((len(full), 2), np.uint64)
            if len(full):
                first, values = at[full], (sets >> np.uint64(32)).astype(np.uint32)
                for k in range(MINIMA):
                    minima[:, k] = np.minimum.reduceat((values ^ _XOR[k]) * _ODD[k], first)
                place = np.arange(len(hashes), dtype=np.uint64) - np.repeat(starts[:-1], np.diff(starts)).astype(np.uint64)
                for i in range(2):
                    terms = mixed(hashes + np.uint64(i)) * (mixed(place + np.uint64(7 + i)) | np.uint64(1))
                    digests[:, i] = np.add.reduceat(terms, starts[full])
            sizes = np.zeros(len(ids), np.int64)
            words, signatures = [None] * len(ids), [None] * len(ids)
            for n, row in enumerate(full):
                sizes[row] = len(np.unique(sets[at[row] : at[row + 1]]))
                words[row] = digests[n].tobytes() + int(starts[row + 1] - starts[row]).to_bytes(4, "big")
                signatures[row] = minima[n].tobytes()
            columns = [ids.cast(pa.int64()), pa.array(words, pa.binary()), pa.array(sizes), pa.array(signatures, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "words", "n_shingles", "signature"])


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for ids, hashes, starts in _word_runs(batch):
            sets, at = shingles(hashes, starts, SHINGLE)
            each = [np.unique(sets[at[i] : at[i + 1]]).view(np.int64) for i in range(len(ids))]
            offsets = np.concatenate(([0], np.cumsum([len(x) for x in each]))).astype(np.int32)
            values = np.concatenate(each) if each else np.empty(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
            yield pa.RecordBatch.from_arrays([ids.cast(pa.int64()), lists], ["doc_id", "shingles"])


def signed(docs: DataFrame) -> DataFrame:
    """Stored (doc_id, words, n_shingles, signature); ``words`` is equal for equal sequences of words."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(rows.mapInArrow(_sign, _SIGNED), "signed")


def _survives(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Compare the signatures of pairs batch by batch; the survivors with their number of equal minima."""
    for pdf in batches:
        if pdf.empty:
            continue
        a, b = (np.frombuffer(b"".join(pdf[c]), np.uint32).reshape(-1, MINIMA) for c in ("sign_a", "sign_b"))
        live, equal = np.arange(len(pdf)), np.zeros(len(pdf), np.int64)
        for seen, least in _LEAST:
            part = slice(seen - BATCH, seen)
            equal[live] += (a[live, part] == b[live, part]).sum(1)
            live = live[equal[live] >= least]
        out = pdf.iloc[live]
        yield pd.DataFrame({"a": out["a"], "b": out["b"], "equal": equal[live]})


def surviving(pairs: DataFrame, signs: DataFrame) -> DataFrame:
    """(a, b, equal) of the pairs that the sequential comparison keeps."""
    side = lambda x: signs.select(F.col("doc_id").alias(x), F.col("signature").alias(f"sign_{x}"))
    joined = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return joined.mapInPandas(_survives, "a long, b long, equal long")


def _similar(shared: Column, a: Column, b: Column) -> Column:
    return 100 * shared >= PERCENT * (a + b - shared)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are links on their full sets."""
    side = lambda x: sets.select(F.col("doc_id").alias(x), F.col("shingles").alias(f"set_{x}"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    return both.filter(_similar(shared, F.size("set_a"), F.size("set_b"))).select("a", "b")


def _compare_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between the outside documents of one block and all documents of another, where components differ."""
    outs, alls = pdf[pdf["outer"]], pdf[~pdf["outer"]]
    links: list[tuple[int, int]] = []
    if len(outs) and len(alls):
        signs = np.frombuffer(b"".join(alls["signature"]), np.uint32).reshape(-1, MINIMA)
        ids, component, outside = alls["doc"].to_numpy(), alls["component"].to_numpy(), alls["outside"].to_numpy()
        sets = alls["shingles"].to_numpy()
        for u, c, sign, own in zip(outs["doc"], outs["component"], outs["signature"], outs["shingles"], strict=True):
            mine = np.frombuffer(sign, np.uint32)
            live = np.flatnonzero((component != c) & (~outside | (ids > u)))
            equal = np.zeros(len(ids), np.int64)
            for seen, least in _LEAST:
                part = slice(seen - BATCH, seen)
                equal[live] += (signs[live, part] == mine[part]).sum(1)
                live = live[equal[live] >= least]
            for n in live:
                other, size = sets[n], len(own) + len(sets[n])
                if 7 * min(len(own), len(other)) < 5 * max(len(own), len(other)):
                    continue
                at = np.minimum(np.searchsorted(own, other), len(own) - 1)
                shared = int((own[at] == other).sum())
                if 100 * shared >= PERCENT * (size - shared):
                    links.append((int(u), int(ids[n])))
    return pd.DataFrame(links, columns=["a", "b"]).astype("int64")


def _block_links(members: DataFrame, signs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links in large buckets. ``members`` has (hub, doc, component) of each document that met the hub in one."""
    hubs = members.filter("hub = doc").select("hub", F.col("component").alias("inner"))
    members = members.join(hubs, "hub").withColumn("outside", F.col("component") != F.col("inner")).drop("inner")
    data = signs.select(F.col("doc_id").alias("doc"), "signature").join(
        sets.select(F.col("doc_id").alias("doc"), "shingles"), "doc"
    )
    sized = stored(members.join(data.select("doc", F.size("shingles").alias("n")), "doc"), "members")
    blocks = lambda n, weight: F.ceil(F.greatest(n / F.lit(BLOCK_DOCS), weight / F.lit(BLOCK_SHINGLES), F.lit(1.0)))
    plan = sized.groupBy("hub").agg(
        F.count_if("outside").alias("outs"),
        blocks(F.count(F.lit(1)), F.sum("n")).alias("all_blocks"),
        blocks(F.count_if("outside"), F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0))).alias("out_blocks"),
    )
    plan = plan.filter("outs > 0")
    own = lambda n: F.pmod(F.xxhash64("doc", F.lit(3)), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    placed = sized.join(plan, "hub")
    outer = placed.filter("outside").select(
        "hub", "doc", "component", "outside", F.lit(True).alias("outer"), own("out_blocks").alias("x"),
        F.explode(every("all_blocks")).alias("y"),
    )
    inner = placed.select(
        "hub", "doc", "component", "outside", F.lit(False).alias("outer"), F.explode(every("out_blocks")).alias("x"),
        own("all_blocks").alias("y"),
    )
    rows = outer.unionByName(inner).join(data, "doc")
    return rows.groupBy("hub", "x", "y").applyInPandas(_compare_blocks, "a long, b long")


def link_texts(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed rows, stored (words, rep, copies, component)): the component of every different sequence of words."""
    rows = signed(docs)
    reps = stored(
        rows.filter(F.col("words").isNotNull()).groupBy("words").agg(
            F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("signature").alias("signature")
        ),
        "reps",
    )
    bands = F.transform(
        F.sequence(F.lit(0), F.lit(BANDS - 1)),
        lambda i: F.xxhash64(F.substring("signature", i * (4 * ROWS) + 1, F.lit(4 * ROWS)), i),
    )
    keyed = reps.select(F.explode(bands).alias("key"), F.col("rep").alias("doc"))
    buckets = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("doc").alias("hub")).filter("n > 1")
    met = stored(keyed.join(buckets, "key"), "met")

    candidates = stored(met.select(F.col("doc").alias("doc_id")).distinct(), "candidates")
    signs = reps.select(F.col("rep").alias("doc_id"), "signature")
    signs = stored(signs.join(candidates, "doc_id", "left_semi"), "signs")
    texts = pick(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), candidates, "doc_id")
    sets = texts.mapInArrow(_shingle_sets, "doc_id long, shingles array<long>").dropDuplicates(["doc_id"])
    sets = stored(sets, "sets")

    stars = met.filter("hub <> doc").select(F.col("hub").alias("b"), F.col("doc").alias("a")).distinct()
    likely = stored(surviving(stars, signs), "stars")
    best = likely.groupBy("a").agg(F.max(F.struct("equal", (-F.col("b")).alias("b"))).alias("best"))
    first = stored(verified(best.select("a", (-F.col("best.b")).alias("b")), sets), "first")
    known = stored(components(first, "a", "b"), "components").select(F.col("node").alias("doc"), "component")
    met = met.join(known, "doc", "left").withColumn("component", F.coalesce("component", "doc"))
    met = stored(met, "met")

    side = lambda x: met.filter(F.col("n") <= LISTED).select("key", F.col("doc").alias(x), F.col("component").alias(f"c{x}"))
    listed = side("a").join(side("b"), "key").filter("a < b AND ca <> cb").select("a", "b").distinct()
    second = verified(surviving(listed, signs), sets)
    members = met.filter(F.col("n") > LISTED).select("hub", "doc", "component").distinct()
    links = first.unionByName(second).unionByName(_block_links(members, signs, sets))
    found = components(links, "a", "b").select(F.col("node").alias("rep"), "component")
    classes = reps.select("words", "rep", "copies").join(found, "rep", "left")
    return rows, stored(classes.withColumn("component", F.coalesce("component", "rep")), "classes")


def near_dedup(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``."""
    rows, classes = link_texts(docs)
    full = rows.filter(F.col("words").isNotNull()).select("doc_id", "n_shingles", "words")
    full = join_groups(full, classes, "words", "copies", rows.count()).select("doc_id", "n_shingles", "component")
    empty = rows.filter(F.col("words").isNull()).select("doc_id", "n_shingles", F.col("doc_id").alias("component"))
    component = F.coalesce("component", "doc_id")
    return full.unionByName(empty).select(
        "doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept")
    )


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(documents(spark, sf_dir).select("doc_id", "text"))
