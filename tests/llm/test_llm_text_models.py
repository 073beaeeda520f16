"""Toxicity, language and quality: models learned from labels, checked on rows that they did not see."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadpulse.llm import langid, quality, toxicity

SYLLABLES = {
    "en": "the ing and tion er ed ly st th wh on re".split(),
    "de": "der ung sch keit ein ich ß ä ü ö ver be".split(),
    "fr": "le eau oux tion è é que ment ai oi ç re".split(),
}


def prose(rng, lang="en", words=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randint(1, 3))) for _ in range(words))


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.fixture(scope="module")
def toxic_rows():
    rng, bad = random.Random(2), ["idiot", "moron", "scumbag", "loser"]
    rows, marks = [], []
    for i in range(700):
        words, toxic = prose(rng, rng.choice(list(SYLLABLES))).split(), i % 6 == 0
        if toxic:
            for w in rng.sample(bad, 2):
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words)))
        marks.append((i, None, int(toxic)))
    return rows, marks


def test_toxicity_on_unseen_and_disguised_words(spark, documents, toxic_rows):
    rows, marks = toxic_rows
    marks = spark.createDataFrame([*marks, (9999, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents(rows), marks)
    disguised = ["you 1d10t", "such a m0r0n here", "l o s e r they said", "loooooser", "i.d.i.o.t", "IDIOT!!", "m@ron id1ot"]
    clean = ["", None, "12345 678", "the ing and", "&&& %%% ***", "a b c d"]
    extra = [(1000 + i, t) for i, t in enumerate(disguised + clean)] + [(2000, "the ing " * 30_000 + "idiot")]
    got = {r["doc_id"]: r for r in toxicity.score_texts(documents([*rows, *extra]).withColumn("score", F.lit("x")), model).collect()}
    for i, _ in rows:
        if fold(i, 3) == 1:
            assert got[i]["predicted"] == int(i % 6 == 0)
    assert all(got[1000 + i]["predicted"] == 1 for i in range(len(disguised))) and got[2000]["predicted"] == 1
    assert all(got[1000 + len(disguised) + i]["score"] == 0 for i in range(len(clean)))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got.values())


def test_disguises_reach_the_decoder():
    """Signs at an end, digits and signs alone, doubled letters, letters set apart by any white space, with marks."""
    rng, words = random.Random(4), ["idiot", "moron", "scum", "ass", "class", "hello", "dull", "boat", "sit", "crime"]
    text = " ".join(rng.choices(words, k=4_000))
    counts = np.full((toxicity.SYMBOLS,) * 3, 0.01)
    symbols = [toxicity.symbol_of(c) for c in f" {text} "]
    np.add.at(counts, (symbols[:-2], symbols[1:-1], symbols[2:]), 1)
    np.add.at(counts, (0, 0, symbols[1:]), 1)
    restorer = toxicity.Restorer(np.log(counts / counts.sum(2, keepdims=True)))
    forms = {"a$$": "ass", "@$$": "ass", "cl@$$": "class", "(cl@$$),": "class", "455": "ass", "iiddiioott": "idiot", "mmoron!": "moron", "hello": "hello", "dull": "dull"}
    for form, word in forms.items():
        assert word in restorer.words(form), form
    spelled = {
        "you i  d\ti\no t there": "idiot", "an i d ! o t": "idiot", "$ c u m": "scum", "m o r o n, he said": "moron",
        "(m 0 r o n)!": "moron", "m o r o n": "moron",
    }
    for form, word in spelled.items():
        assert word in restorer.spelled(form), form
    assert restorer.spelled("a b") == [] and restorer.words("&&&") == restorer.words("***") == ()


def test_copies_of_a_toxic_text_give_its_words_no_weight(spark, documents, toxic_rows):
    rows, marks = toxic_rows
    copied = [(5000 + i, "entirely innocent vocabulary around an idiot moron") for i in range(200)]
    marks = spark.createDataFrame([*marks, *((i, None, 1) for i, _ in copied)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents([*rows, *copied]), marks)
    assert "idiot" in model.evidence and "innocent" not in model.evidence


def test_decoding_is_the_best_reading():
    """Against listing every reading of the lattice."""
    rng = np.random.default_rng(1)
    model = np.log(rng.dirichlet(np.ones(toxicity.SYMBOLS), (toxicity.SYMBOLS, toxicity.SYMBOLS)))

    def total(reading, cost):
        x = y = toxicity.BORDER
        for c in [*reading, " "]:
            z = toxicity.symbol_of(c)
            cost, x, y = cost + model[x, y, z], y, z
        return cost

    for token in ("1d10t", "a b c", "lo00oser", "$t!ll", "x"):
        every = [("", 0.0)]
        for options in toxicity.readings(token):
            every = [(text + s, cost + c) for text, cost in every for s, c in options]
        best = max(total(text, cost) for text, cost in every)
        found = toxicity.decode(token, model)
        assert math.isclose(max(total(t, c) for t, c in every if t == found), best, rel_tol=1e-6)


def test_nothing_toxic_to_learn(spark, documents):
    marks = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(documents([(1, "a b"), (2, None)]), marks)
    assert {r["score"] for r in toxicity.score_texts(documents([(1, "x"), (2, None)]), model).collect()} == {0.0}
    assert toxicity.score_texts(documents([]), model).count() == 0


def test_suffix_automaton_accepts_exactly_the_substrings():
    rng = random.Random(3)
    for _ in range(30):
        text = [rng.randint(0, 2) for _ in range(rng.randint(1, 25))]
        table = langid.suffix_automaton(np.array(text), 3)
        inside = {tuple(text[i:j]) for i in range(len(text)) for j in range(i, len(text) + 1)}
        for _ in range(60):
            probe = tuple(rng.randint(0, 2) for _ in range(rng.randint(1, 6)))
            state = 0
            for c in probe:
                state = table[state, c] if state >= 0 else -1
            assert (state >= 0) == (probe in inside)


def test_phrases_are_those_of_a_greedy_parse():
    rng = random.Random(8)
    samples = {x: [prose(rng, x, 60) for _ in range(3)] for x in SYLLABLES}
    model = langid.build(samples)
    texts = [prose(rng, x, n) for x in SYLLABLES for n in (1, 5, 300)] + ["", "123", "a", "ÀÉ ß 日本"]
    phrases, n_letters = langid.count_phrases(texts, model)
    for t, text in enumerate(texts):
        assert n_letters[t] == sum(c.isalpha() for c in text)
        classes = langid._collapsed(langid.classes_of(langid._points(text), model.classes)).tolist()
        for k, name in enumerate(model.names):
            whole = np.concatenate([langid._points(" " + x.lower()) for x in samples[name]])[: langid.SAMPLE_CHARS]
            known = "".join(map(chr, langid._collapsed(langid.classes_of(whole, model.classes)) + 1))
            count = 0
            for begin in range(0, len(classes) if n_letters[t] else 0, langid.BLOCK):
                block, at = "".join(chr(c + 1) for c in classes[begin : begin + langid.BLOCK]), 0
                while at < len(block):
                    n = 1
                    while at + n < len(block) and block[at : at + n + 1] in known:
                        n += 1
                    count, at = count + 1, at + n
            assert phrases[t, k] == count


def test_languages_of_unseen_texts(spark, documents, written):
    rng = random.Random(6)
    rows = [(i, prose(rng, lang, rng.choice([8, 40, 200])), lang, None) for i, lang in enumerate(list(SYLLABLES) * 80)]
    odd = [(1000, None, "en", None), (1001, "", "en", None), (1002, "12 % 34", "de", None), (None, prose(rng, "de"), "de", None)]
    odd += [(1003, prose(rng, "fr", 30_000), None, None), (1004, rows[1][1], None, None)]
    got = langid.op6_cross_parsing(spark, written(documents=documents([*rows, *odd]))).collect()
    assert len(got) == len(rows) + len(odd)
    found = {r["doc_id"]: r for r in got}
    held = [i for i, *_ in rows if fold(i, 4) == 2]
    assert all(found[i]["held_out"] for i in held) and not found[None]["held_out"]
    assert sum(found[i]["lang_pred"] == rows[i][2] for i in held) >= 0.98 * len(held)
    assert all(found[i]["lang_pred"] == "und" and found[i]["score"] == 0 for i in (1000, 1001, 1002))
    assert found[None]["lang_pred"] == "de" and found[1003]["lang_pred"] == "fr"
    assert all(0 <= r["score"] <= 1 for r in got)


def test_a_language_with_one_or_two_short_labelled_texts():
    """It shares half its syllables with one of 64 texts, and keeps its own documents without taking others."""
    rng = random.Random(13)
    near = SYLLABLES["en"][:6] + "os ar un".split()
    text = lambda x, n: " ".join("".join(rng.choices(near if x == "xx" else SYLLABLES[x], k=rng.randint(1, 3))) for _ in range(n))
    for pieces in ([text("xx", 60)], [text("xx", 30), text("xx", 30)]):
        samples = {x: [text(x, 260) for _ in range(langid.TEXTS)] for x in SYLLABLES} | {"xx": pieces}
        model = langid.build(samples)
        for x in (*SYLLABLES, "xx"):
            phrases, _ = langid.count_phrases([text(x, 120) for _ in range(100)], model)
            right = np.array(model.names)[(phrases / model.needs).argmin(1)] == x
            assert right.mean() >= 0.9, (x, right.mean(), (np.array(model.names)[phrases.argmin(1)] == x).mean())


def test_all_drawn_text_is_in_the_automaton():
    rng = random.Random(14)
    pieces = [prose(rng, "en", 400)[: langid.TEXT_CHARS - 10] + " qzx" + chr(0x3B1 + i % 24) * (1 + i // 24) for i in range(langid.TEXTS)]
    model = langid.build({"en": pieces, "de": [prose(rng, "de", 300)]})
    phrases, _ = langid.count_phrases([p[-40:] for p in pieces], model)
    assert (phrases[:, model.names.index("en")] == 1).all()


def test_language_without_labels_or_rows(documents):
    model = langid.build(langid.labelled_samples(documents([(1, "text", None, None)])))
    assert [r["lang_pred"] for r in langid.identify(documents([(1, "text")]), model).collect()] == ["und"]
    assert langid.identify(documents([]), model).count() == 0


def junk(rng):
    return " ".join(w + rng.choice(["%%%", "***", "###"]) for w in prose(rng, "en", 50).split())


def test_quality_on_unseen_rows(spark, documents):
    rng = random.Random(7)
    rows = [(i, junk(rng) if i % 5 == 0 else prose(rng, rng.choice(list(SYLLABLES)), rng.randint(10, 120))) for i in range(800)]
    marks = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _ in rows if i % 2 or i % 5 == 0], "doc_id long, quality int, toxic int")
    odd = [(900, None), (901, ""), (902, prose(rng, "en", 40_000)), (None, "the and"), (5, rows[5][1])]
    docs = documents([*rows, *odd])
    got = quality.classify(docs.withColumn("accepted", F.lit(1)), quality.fit(docs, marks)).collect()
    assert len(got) == len(rows) + len(odd)
    wrong = [r["doc_id"] for r in got if r["doc_id"] is not None and r["doc_id"] < 800 and r["accepted"] != (r["doc_id"] % 5 != 0)]
    assert len(wrong) <= 4
    assert all(r["accepted"] for r in got if r["doc_id"] in (900, 901, 902))


def test_one_long_text_changes_nothing(spark, documents):
    """A text 400 times as long as others leaves the accepted rows as they were."""
    rng = random.Random(8)
    rows = [(i, junk(rng) if i % 5 == 0 else prose(rng, rng.choice(list(SYLLABLES)), rng.randint(10, 120))) for i in range(800)]
    marks = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i, _ in rows if i % 2 or i % 5 == 0], "doc_id long, quality int, toxic int")
    verdicts = []
    for extra in ([], [(901, " ".join([rows[5][1]] * 400)), (902, prose(rng, "en", 30_000))]):
        docs = documents([*rows, *extra])
        verdicts.append({r["doc_id"]: r["accepted"] for r in quality.classify(docs, quality.fit(docs, marks)).collect()})
    changed = [i for i, _ in rows if verdicts[0][i] != verdicts[1][i]]
    assert len(changed) <= 2 and sum(verdicts[1][i] != (i % 5 != 0) for i, _ in rows) <= 4


def test_quality_model_equals_a_plain_count(spark, documents):
    """Shares of bins, ratios and scores, recomputed text by text with the same hashes."""
    rng = random.Random(10)
    rows = [(i, prose(rng, "en", rng.randint(0, 30))) for i in range(60)] + [(70, "a a a a b"), (71, None)]
    good = {i for i in range(60) if i % 3 == 0}
    marks = spark.createDataFrame([(i, int(i in good), 0) for i in range(60)], "doc_id long, quality int, toxic int")
    raw, target, bins_of = np.zeros(quality.BINS), np.zeros(quality.BINS), {}
    for i, text in rows:
        hashes, _ = quality.hash_words(np.frombuffer((text or "").encode(), np.uint8), np.array([0, len((text or "").encode())]))
        pairs = [0 if a == b else quality.mixed(np.array([a * 3 + b & (1 << 64) - 1], np.uint64))[0] for a, b in zip(map(int, hashes), map(int, hashes[1:]))]
        bins_of[i] = [int(h) % quality.BINS for h in (*hashes, *pairs)]
        for b in set(bins_of[i]):
            share = (bins_of[i].count(b) << quality.SHARE_BITS) // len(bins_of[i])
            raw[b] += share
            target[b] += share * (i in good and fold(i, 5) not in (0, 1))
    ratio = quality.log_ratios(raw, target)
    model = quality.fit(documents(rows), marks)
    np.testing.assert_allclose(model.log_ratio, ratio, atol=1e-12)
    scores = {i: sum(ratio[b] for b in bins) / (len(bins) + quality.SHRINK) for i, bins in bins_of.items()}
    got = {r["doc_id"]: r["score"] for r in quality.classify(documents(rows), model).collect()}
    assert got == pytest.approx(scores)
    held = [i for i in range(60) if fold(i, 5) == 1]
    assert model.cut == pytest.approx(quality.best_cut(np.array([scores[i] for i in held]), np.array([i in good for i in held])))


def test_cut_has_the_least_weighted_error():
    rng = np.random.default_rng(3)
    for _ in range(50):
        good = rng.random(40) < 0.7
        scores = np.round(rng.normal(good * 1.5, 1), 1)
        cut = quality.best_cut(scores, good)
        error = lambda c: quality.GOOD_WEIGHT * (scores[good] < c).mean() + (scores[~good] >= c).mean()  # noqa: B023,E731
        assert error(cut) == pytest.approx(min(error(c) for c in [-np.inf, *scores, scores.max() + 1]))
    assert quality.best_cut(np.array([1.0, 2.0]), np.array([True, True])) == 1.0
    assert quality.best_cut(np.array([1.0, 2.0]), np.array([False, False])) == -np.inf


def test_gumbel_top_k_is_the_k_largest_keys(spark, monkeypatch):
    monkeypatch.setattr(quality, "EXACT_ROWS", 5)
    rng = random.Random(9)
    rows = [(i, rng.gauss(0, 30) if i % 3 else 0.0) for i in range(3000)] + [(i, 1.0) for i in range(40)]
    rows += [(7, 80.0)] * 300 + [(None, 60.0)] * 200  # a third of the largest keys is one row's copies
    df = spark.createDataFrame(rows, "doc_id long, log_weight double")
    for k in (0, 1, 250, 450, 700, 3540):
        got = quality.gumbel_top_k(df, k).collect()
        assert len(got) == len(rows) and sum(r["sampled"] for r in got) == k
        chosen = [r["gumbel_key"] for r in got if r["sampled"]]
        assert sorted(chosen, reverse=True) == sorted((r["gumbel_key"] for r in got), reverse=True)[:k]
    assert quality.gumbel_top_k(df.limit(0), 3).count() == 0


def test_quality_without_good_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality.resample(documents([(1, "a b"), (2, None)]), none).collect()
    assert {(r["log_weight"], r["accepted"]) for r in got} == {(0.0, True)} and sum(r["sampled"] for r in got) == 1
    assert quality.resample(documents([]), none).count() == 0
