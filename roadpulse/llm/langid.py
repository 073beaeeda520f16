"""Language identification by cross-parsing entropy.

For each language a suffix automaton of labelled text accepts exactly the substrings of that text. A document is
parsed against it greedily: a phrase is the longest match from where the last one ended. The language wins for which
the document needs the fewest phrases in relation to what unseen text of that language needs with the same automaton,
since a small automaton needs more phrases for its own language too; ties go to the first name. That need is measured
by parsing one half of a language's sample with an automaton of the other half, relative to the mean of the other
languages' text, and carried over to the whole automaton.

Characters are letters, lower-cased, in at most ALPHABET classes found in the labelled text (rarer ones share RARE_CLASSES
more by a hash), with one class for all runs of anything else. Documents are parsed in blocks of BLOCK characters, so that a
very long one is no longer step than others; a phrase ends at a block's end. All blocks of a batch and all languages
advance together, one character at a time, in one table of transitions, where a dead end is a flag and leads to where
the next phrase starts. Memory is bounded by the batch and by the labelled text.

That text is a bounded sample: per language TEXTS texts, those first in a seeded order, of which TEXT_CHARS characters
from the middle are used, all of them. A language with less labelled text has a smaller automaton.

Defined results: ``und`` with score 0 if the text is NULL or has no letter, or if nothing is labelled. The score is
1 - (relative phrases of the winner / those of the runner-up), 1 if there is only one language. An empty table gives an empty
result. Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from roadpulse.llm.common import documents, fold_of, stored

FOLDS, HELD_OUT = 4, 2
TEXTS, TEXT_CHARS = 64, 1_500
SAMPLE_CHARS = TEXTS * (TEXT_CHARS + 1)
ALPHABET, RARE_CLASSES = 63, 16
BLOCK = 512
#: Characters parsed at a time.
RUN_CHARS = 1 << 20
OTHER = 0
RESULT = ("lang_pred", "score")


@dataclass(frozen=True)
class LanguageModel:
    """``table[state * width + class]`` is the next state times ``width``, shifted left, with a flag for a new phrase."""

    names: tuple[str, ...]
    classes: np.ndarray
    width: int
    table: np.ndarray
    roots: np.ndarray
    #: Phrases that a character of a language's own text needs.
    needs: np.ndarray


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)


def _is_letter() -> np.ndarray:
    """For each code point of the first plane, whether it is a letter; one class stands for all beyond."""
    return np.array([chr(c).isalpha() for c in range(0x10000)])


_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(_is_letter())
    return _LETTERS[0]


def suffix_automaton(text: np.ndarray, width: int) -> np.ndarray:
    """Transitions (state, class) -> state of the automaton of all substrings of ``text``; -1 where there is none."""
    n = len(text)
    table = np.full((2 * n + 2, width), -1, np.int32)
    link, length = [-1], [0]
    last, rows = 0, [{}]
    for c in text.tolist():
        state = len(rows)
        rows.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in rows[p]:
            rows[p][c] = state
            p = link[p]
        if p != -1:
            q = rows[p][c]
            if length[p] + 1 == length[q]:
                link[state] = q
            else:
                copy = len(rows)
                rows.append(dict(rows[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and rows[p].get(c) == q:
                    rows[p][c] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    for state, row in enumerate(rows):
        if row:
            table[state, list(row)] = list(row.values())
    return table[: len(rows)]


def build(samples: dict[str, list[str]]) -> LanguageModel:
    names = tuple(sorted(samples))
    texts = [np.concatenate([_points(" " + t.lower()) for t in samples[x]])[:SAMPLE_CHARS] for x in names]
    known = letters()
    plane = np.concatenate(texts) if texts else np.empty(0, np.uint32)
    plane = plane[plane < 0x10000]
    found, counts = np.unique(plane[known[plane]], return_counts=True)
    common = found[np.argsort(-counts, kind="stable")[: ALPHABET - 1]]
    # Letters beyond these share a few classes by a hash, so that languages in scripts of their own differ in them.
    rare, shared = len(common) + 1, RARE_CLASSES if len(found) > len(common) else 1
    spread = (np.arange(len(known), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shared)
    classes = np.where(known, rare + spread.astype(np.int64), OTHER).astype(np.int32)
    classes[common] = np.arange(1, len(common) + 1)
    for c in np.flatnonzero(known):  # capital letters share the class of the small ones
        small = chr(c).lower()
        if len(small) == 1 and ord(small) < 0x10000:
            classes[c] = classes[ord(small)]
    model = _automata(dict(zip(names, texts, strict=True)), classes, rare + shared)
    return replace(model, needs=_needs(model, samples))


def _automata(texts: dict[str, np.ndarray], classes: np.ndarray, width: int) -> LanguageModel:
    parts, roots, offset = [], [], 0
    for text in texts.values():
        table = suffix_automaton(_collapsed(classes_of(text, classes)), width).astype(np.int64)
        # Behind the automaton a state where nothing is read yet; a character that it lacks is a phrase and leads there.
        none = len(table)
        begun = (np.where(table[0] >= 0, table[0], none) + offset) * (2 * width) + 1
        moved = np.where(table >= 0, (table + offset) * (2 * width), begun)
        parts += [moved.ravel(), begun]
        roots.append((offset + none) * width)
        offset += none + 1
    kind = np.int32 if offset * 2 * width < 1 << 31 else np.int64
    table = np.concatenate([part.astype(kind) for part in parts]) if parts else np.empty(0, kind)
    return LanguageModel(tuple(texts), classes, width, table, np.array(roots, kind), np.ones(len(texts)))


def _halves(pieces: list[str]) -> tuple[str, str]:
    """Every other piece and the rest; the only piece is cut in the middle."""
    if len(pieces) > 1:
        return " ".join(pieces[::2]), " ".join(pieces[1::2])
    half = len(pieces[0]) // 2
    return pieces[0][:half], pieces[0][half:]


def _needs(model: LanguageModel, samples: dict[str, list[str]]) -> np.ndarray:
    languages = len(model.names)
    if languages < 2:
        return np.ones(languages)

    def rates(texts: list[str], parser: LanguageModel) -> np.ndarray:
        phrases, n_letters = count_phrases(texts, parser)
        return np.where(n_letters[:, None] > 0, phrases / np.maximum(n_letters, 1)[:, None], np.nan)

    def of_others(found: np.ndarray) -> np.ndarray:
        """Of each automaton the mean over the other languages' texts; 1 if none has a letter."""
        foreign = np.where(np.eye(languages, dtype=bool), np.nan, found)
        n = np.count_nonzero(~np.isnan(foreign), 0)
        return np.where(n > 0, np.nansum(foreign, 0) / np.maximum(n, 1), 1.0)

    halves = [_halves(samples[x]) for x in model.names]
    shares = []
    for own, unseen in ((0, 1), (1, 0)):
        half = _automata({x: _points(" " + h[own].lower()) for x, h in zip(model.names, halves, strict=True)}, model.classes, model.width)
        found = rates([h[unseen] for h in halves], half)
        shares.append(np.minimum(1.0, np.nan_to_num(np.diag(found) / of_others(found), nan=1.0)))
    return np.mean(shares, 0) * of_others(rates([" ".join(samples[x]) for x in model.names], model))


def classes_of(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each character; a letter beyond the first plane is in the class of the rare ones."""
    beyond = points >= 0x10000
    out = classes[np.where(beyond, 0, points)]
    if beyond.any():
        out[beyond] = [classes.max() if chr(c).isalpha() else OTHER for c in points[beyond]]
    return out


def _collapsed(classes: np.ndarray) -> np.ndarray:
    """Runs of the class of all other characters as one."""
    keep = np.ones(len(classes), bool)
    keep[1:] = (classes[1:] != OTHER) | (classes[:-1] != OTHER)
    return classes[keep]


def count_phrases(texts: list[str], model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Phrases (text, language) and the number of letters of each text."""
    languages = len(model.names)
    lanes, owner, n_letters = [], [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        classes = classes_of(_points(text), model.classes)
        n_letters[i] = np.count_nonzero(classes)
        if n_letters[i]:
            classes = _collapsed(classes)
            cuts = range(0, len(classes), BLOCK)
            lanes += [classes[c : c + BLOCK] for c in cuts]
            owner += [i] * len(cuts)
    phrases = np.zeros((len(texts), languages), np.int64)
    if not lanes:
        return phrases, n_letters
    order = np.argsort([-len(x) for x in lanes], kind="stable")
    sizes = np.array([len(lanes[i]) for i in order])
    steps = np.zeros((sizes[0], len(lanes)), np.int32)
    for n, i in enumerate(order):
        steps[: sizes[n], n] = lanes[i]
    base = np.repeat(model.roots[:, None], len(lanes), 1)
    count = np.zeros((languages, len(lanes)), np.int32)
    live = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")
    for k, row in enumerate(steps):
        n = live[k]
        found = model.table[base[:, :n] + row[:n]]
        count[:, :n] += found & 1
        base[:, :n] = found >> 1
    np.add.at(phrases, np.array(owner)[order], count.T)
    return phrases, n_letters


def _predictor(shared):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array([*model.names, "und"], dtype=object)
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.large_string()).fill_null("").to_pylist()
            winners, scores = [], []
            begin = 0
            while begin < len(texts):
                end, chars = begin, 0
                while end < len(texts) and (chars < RUN_CHARS or end == begin):
                    chars += len(texts[end])
                    end += 1
                phrases, n_letters = count_phrases(texts[begin:end], model)
                if len(model.names):
                    relative = phrases / model.needs
                    ranked = np.sort(relative, 1)
                    best = relative.argmin(1)
                    score = 1 - ranked[:, 0] / np.where(ranked[:, 1] > 0, ranked[:, 1], 1) if len(model.names) > 1 else np.ones(end - begin)
                    best = np.where(n_letters > 0, best, len(model.names))
                    score = np.where(n_letters > 0, score, 0.0)
                else:
                    best, score = np.zeros(end - begin, np.int64), np.zeros(end - begin)
                winners += names[best].tolist()
                scores += score.tolist()
                begin = end
            columns = [*batch.columns, pa.array(winners, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, *RESULT])

    return predict


def labelled_samples(docs: DataFrame, lang: str = "lang") -> dict[str, list[str]]:
    """Up to TEXTS pieces of text per language, first in a seeded order; a language is cut into 256 buckets for that."""
    start = F.greatest(F.lit(1), ((F.length("text") - TEXT_CHARS) / 2).cast("int"))
    known = docs.filter(F.col(lang).isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    draw = F.xxhash64(F.col("doc_id"), F.lit(6))
    drawn = known.select(lang, draw.alias("draw"), F.substring(F.col("text"), start, F.lit(TEXT_CHARS)).alias("piece"))
    counts = stored(drawn.groupBy(lang, F.shiftright("draw", 50).alias("part")).count(), "languages")
    upto = F.sum("count").over(W.partitionBy(lang).orderBy("part")) - F.col("count")
    parts = counts.withColumn("before", upto).filter(F.col("before") < TEXTS)
    last = parts.groupBy(lang).agg(F.max("part").alias("last"))
    chosen = drawn.join(F.broadcast(last), lang).filter(F.shiftright("draw", 50) <= F.col("last"))
    ranked = chosen.withColumn("n", F.row_number().over(W.partitionBy(lang).orderBy("draw", "piece")))
    samples: dict[str, list[str]] = {}
    for row in ranked.filter(F.col("n") <= TEXTS).orderBy(lang, "n").collect():
        samples.setdefault(row[0], []).append(row["piece"])
    return samples


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop(*RESULT)
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    return docs.mapInArrow(_predictor(shared), T.StructType([*docs.schema.fields, *fields]))


def op6_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(fold_of(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False))
    model = build(labelled_samples(docs.filter(~held_out)))
    found = identify(docs.select("doc_id", F.col("text").cast("string")), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
