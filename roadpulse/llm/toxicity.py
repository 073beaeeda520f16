"""Toxicity of restored text: noisy-channel deobfuscation, then evidence of words.

Deobfuscation. A token that is not plain (it has a digit, a sign or a character twice in a row, or is one of several
characters set apart by white space) becomes a lattice: a sign may stand for the letters it resembles or for nothing, a
repeated character for one or two, a gap between single ones for a word border or for nothing. Viterbi decoding under a
character trigram model with word borders picks the likeliest reading; with a repeated character also the likeliest that
keeps all repetitions, and of letters alone that is the word as it is. The model counts the trigrams of all documents;
plain words, which are their own only reading, are not decoded.

Evidence. Features are words and their prefixes of 4 to 6 letters. Training texts are clustered first (shared MinHash
bands of three-word shingles), and one text of each cluster counts, so that a copied text gives its words no weight.
A feature seen in ``a`` toxic and ``c`` other texts is an indicator with posterior odds
PRIOR * (HIT / base)^a * ((1 - HIT) / (1 - base))^c, where base is the share of toxic texts. The score is the
probability that at least one of the text's words indicates: 1 - prod(1 - HIT * posterior), each different word once.

Learning uses a bounded sample, the TRAIN_ROWS labelled rows that come first in a seeded order, of those whose
crc32(id) mod 3 is not 1. Nothing but the text enters a score.

Defined results: a NULL or empty text has score 0. Without toxic training rows all scores are 0. An empty table gives
an empty result. Columns of the input named like a result column are replaced. Long texts are read in full.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.common import documents, fold_of, labels, stored
from roadpulse.llm.components import components
from roadpulse.llm.words import hash_words, mixed, runs, shingles

FOLDS, HELD_OUT = 3, 1
TRAIN_ROWS = 12_000
PREFIXES = (4, 5, 6)
PRIOR, HIT = 1e-5, 0.97
#: Features below this posterior are no evidence.
LEAST_POSTERIOR = 0.3
LEAST_SUPPORT = 3
PREDICT_AT = 0.7
KEPT_WORDS = 300_000
RESULT = ("score", "predicted")

# Letters that a sign resembles. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "£": "l", "¡": "i", "¥": "y",
}
SUBSTITUTE, DROP_SIGN, DROP_DIGIT, DROP_REPEAT, GAP = (math.log(p) for p in (0.3, 0.05, 1e-4, 0.5, 0.5))
SYMBOLS = 64
BORDER = 0

_EDGE = re.compile(r"^[^\w@$]+|[^\w@$]+$")
_PLAIN = re.compile(r"[^\W\d_]*\Z")
_DOUBLE = re.compile(r"(.)\1")
_SPELLED = re.compile(r"(?<!\S)[^\w\s@$]*((?:[^\W_]|[%s])(?:\s+(?:[^\W_]|[%s])){2,})[^\w\s]*(?!\S)" % ((re.escape("".join(LEET)),) * 2))
_STRETCH = re.compile(r"[^\W\d_]{3,}")
_READABLE = re.compile(r"[^\W\d_]|[%s]" % re.escape("".join(LEET)))


def symbol_of(char: str) -> int:
    """The model's symbol of a lower-case character: the border, 26 letters, 37 classes of other letters."""
    if "a" <= char <= "z":
        return ord(char) - 96
    return 27 + ord(char) % 37 if char.isalpha() else BORDER


_symbols: list[np.ndarray] = []


def _symbol_table() -> np.ndarray:
    if not _symbols:
        lower = lambda c: x if len(x := chr(c).lower()) == 1 else chr(c)
        _symbols.append(np.array([symbol_of(lower(c)) for c in range(0x10000)], np.int32))
    return _symbols[0]


def _count_trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, counts = _symbol_table(), np.zeros(SYMBOLS**3, np.int64)
    for batch in batches:
        for text in batch.column(0).cast(pa.large_string()).fill_null("").to_pylist():
            points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            symbols = np.concatenate(([BORDER], table[np.where(points < 0x10000, points, 0)], [BORDER]))
            keep = (symbols != BORDER) | np.concatenate(([True], symbols[:-1] != BORDER))
            symbols = symbols[keep]
            if len(symbols) > 2:
                counts += np.bincount(symbols[:-2] * SYMBOLS**2 + symbols[1:-1] * SYMBOLS + symbols[2:], minlength=SYMBOLS**3)
    hit = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(counts[hit])], ["trigram", "n"])


def character_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [x, y, z] of symbol z after x, y, from all texts; only SYMBOLS^3 counts reach the driver."""
    found = docs.select(F.col("text").cast("string")).mapInArrow(_count_trigrams, "trigram long, n long")
    three = np.zeros(SYMBOLS**3)
    for row in found.groupBy("trigram").agg(F.sum("n").alias("n")).collect():
        three[row["trigram"]] = row["n"]
    three = three.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
    two, one = three.sum(0), three.sum((0, 1))
    p1 = (one + 1) / (one.sum() + SYMBOLS)
    p2 = (two + 20 * p1) / (two.sum(1, keepdims=True) + 20)
    return np.log((three + 20 * p2[None]) / (three.sum(2, keepdims=True) + 20)).astype(np.float32)


def readings(token: str, repeats: bool = True) -> list[list[tuple[str, float]]]:
    """For each character of a token, the strings that it may stand for, with log probabilities.

    Without ``repeats`` a repeated character is not left out for being one.
    """
    lattice, last = [], ""
    for char in token:
        if char == " ":
            lattice.append([("", GAP), (" ", GAP)])
            continue
        if char.isalpha():
            options = [(char, 0.0)]
        else:
            options = [(c, SUBSTITUTE) for c in LEET.get(char, "")] + [("", DROP_DIGIT if char.isdigit() else DROP_SIGN)]
        if repeats and char == last:
            options.append(("", DROP_REPEAT))
        lattice.append(options)
        last = char
    return lattice


def decode(token: str, model: np.ndarray, repeats: bool = True) -> str:
    """The likeliest reading of a token, or of letters with spaces between them."""
    states = {(BORDER, BORDER): (0.0, "")}
    for options in readings(token, repeats):
        following: dict[tuple[int, int], tuple[float, str]] = {}
        for (x, y), (score, text) in states.items():
            for string, cost in options:
                if string:
                    z = symbol_of(string)
                    state, total, out = (y, z), score + cost + float(model[x, y, z]), text + string
                else:
                    state, total, out = (x, y), score + cost, text
                if state not in following or total > following[state][0]:
                    following[state] = (total, out)
        states = following
    return max((score + float(model[x, y, BORDER]), text) for (x, y), (score, text) in states.items())[1]


class Restorer:
    """Restores the words of lower-case text in one task; each different token is decoded once."""

    def __init__(self, model: np.ndarray) -> None:
        self.model = model

    def words(self, token: str) -> tuple[str, ...]:
        core = _EDGE.sub("", token)
        plain, doubled = _PLAIN.match(core), _DOUBLE.search(core)
        if plain and not doubled:
            return (core,) if core else ()
        if not _READABLE.search(core):
            return ()
        found = decode(core, self.model).split()
        if plain:
            return tuple(dict.fromkeys([core, *found]))
        if doubled:
            found += decode(core, self.model, repeats=False).split()
        simple = re.sub(r"^\W+|\W+$", "", core)
        return tuple(dict.fromkeys([*found, *_STRETCH.findall(simple)]))

    def spelled(self, text: str) -> list[str]:
        """Words read from single letters, digits or signs set apart by white space."""
        return [w for m in _SPELLED.finditer(text) for w in decode(" ".join(m[1].split()), self.model).split()]


def features_of(word: str) -> list[str]:
    return [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]


@dataclass(frozen=True)
class ToxicityModel:
    characters: np.ndarray
    #: Feature -> log(1 - HIT * posterior).
    evidence: dict[str, float]


class _Evidence(dict):
    """Token -> words of it that are evidence, worked out once."""

    def __init__(self, restorer: Restorer, evidence: dict[str, float]) -> None:
        super().__init__()
        self.restorer, self.evidence = restorer, evidence

    def of(self, word: str) -> float:
        return min((self.evidence[f] for f in features_of(word) if f in self.evidence), default=0.0)

    def __missing__(self, token: str) -> tuple[tuple[str, float], ...]:
        found = tuple((w, e) for w in self.restorer.words(token) if (e := self.of(w)))
        self[token] = found
        return found


def _scorer(shared):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        restorer = Restorer(model.characters)
        kept = _Evidence(restorer, model.evidence)
        for batch in batches:
            scores = []
            for text in batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).fill_null("").to_pylist():
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                text = text.lower()
                found = dict(hit for hits in map(kept.__getitem__, set(text.split())) if hits for hit in hits)
                for word in restorer.spelled(text):
                    if weight := kept.of(word):
                        found[word] = weight
                scores.append(1 - math.exp(sum(sorted(found.values()))))
            scores = pa.array(scores, pa.float64())
            predicted = pa.array((scores.to_numpy() >= PREDICT_AT).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*batch.columns, scores, predicted], [*batch.schema.names, *RESULT])

    return score


def score_texts(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*RESULT)
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return docs.mapInArrow(_scorer(shared), T.StructType([*docs.schema.fields, *fields]))


BANDS, ROWS = 12, 3


def _cluster_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for begin, end, data, starts in runs(batch.column(1)):
            sets, at = shingles(*hash_words(data, starts), 3)
            full = np.flatnonzero(np.diff(at))
            minima = np.empty((len(full), BANDS * ROWS), np.uint64)
            for k in range(BANDS * ROWS if len(full) else 0):
                minima[:, k] = np.minimum.reduceat(mixed(sets + np.uint64(k * 7919)), at[full])
            keys = minima.reshape(len(full), BANDS, ROWS)
            joined = mixed(keys[:, :, 0] + mixed(keys[:, :, 1] + mixed(keys[:, :, 2] + np.arange(BANDS, dtype=np.uint64))))
            ids = batch.column(0).slice(begin, end - begin).take(pa.array(np.repeat(full, BANDS)))
            yield pa.RecordBatch.from_arrays([ids, pa.array(joined.ravel().view(np.int64))], ["doc_id", "key"])


def _one_per_cluster(sample: DataFrame) -> DataFrame:
    """Of texts that share a band, directly or through others, the one with the smallest id."""
    keyed = stored(sample.select("doc_id", "text").mapInArrow(_cluster_keys, "doc_id long, key long"), "clusters")
    least = keyed.groupBy("key").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    links = keyed.join(least, "key").filter("doc_id <> least").select("doc_id", "least").distinct()
    linked = components(stored(links, "links"), "doc_id", "least").filter("node <> component")
    return sample.join(linked.select(F.col("node").alias("doc_id")), "doc_id", "left_anti")


def _feature_counter(characters, wanted):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, only = Restorer(characters.value), wanted.value if wanted else None
        counts: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                text = (text or "").lower()
                words = {w for token in set(text.split()) for w in restorer.words(token)} | set(restorer.spelled(text))
                found = {f for w in words for f in features_of(w)}
                counts.update(found if only is None else found & only)
        rows = list(counts.items())
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64())], ["feature", "n"])

    return count


def fit(docs: DataFrame, marks: DataFrame) -> ToxicityModel:
    spark = docs.sparkSession
    characters = character_model(docs)
    known = marks.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    known = known.filter(fold_of(F.col("doc_id"), FOLDS) != HELD_OUT).select("doc_id", F.col("toxic").cast("int"))
    known = known.orderBy(F.xxhash64("doc_id", F.lit(2)), "doc_id", "toxic").limit(TRAIN_ROWS).dropDuplicates(["doc_id"])
    texts = docs.select("doc_id", F.col("text").cast("string")).join(F.broadcast(stored(known, "marks")), "doc_id")
    sample = stored(_one_per_cluster(stored(texts.dropDuplicates(["doc_id"]), "texts")), "sample").repartition(16)
    sizes = {row["toxic"]: row["count"] for row in sample.groupBy("toxic").count().collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic:
        return ToxicityModel(characters, {})
    shared = spark.sparkContext.broadcast(characters)

    def counts(label: int, wanted=None) -> DataFrame:
        rows = sample.filter(F.col("toxic") == label).select("text").mapInArrow(_feature_counter(shared, wanted), "feature string, n long")
        return rows.groupBy("feature").agg(F.sum("n").alias("n"))

    often = {r["feature"]: r["n"] for r in counts(1).filter(F.col("n") >= LEAST_SUPPORT).collect()}
    against = {r["feature"]: r["n"] for r in counts(0, spark.sparkContext.broadcast(frozenset(often))).collect()}
    base = (toxic + 1) / (toxic + other + 2)
    evidence = {}
    for feature, a in often.items():
        c = against.get(feature, 0)
        odds = math.log(PRIOR) + a * math.log(HIT / base) + c * math.log((1 - HIT) / (1 - base))
        posterior = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        if posterior >= LEAST_POSTERIOR:
            evidence[feature] = math.log(1 - HIT * posterior)
    return ToxicityModel(characters, evidence)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = score_texts(docs.select("doc_id", F.col("text").cast("string")), fit(docs, labels(spark, sf_dir)))
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")
