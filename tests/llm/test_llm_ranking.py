"""Ranked search against scoring every document for every item."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from roadpulse.llm import ranking

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def expected(docs, items, depth):
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    total, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out, wanted = [], {}
    for item, text in items:
        wanted.setdefault(item, set()).update(terms(text))
    for item, words in wanted.items():
        scored = []
        for i, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * total) // length
            score = 0
            for t in words & set(c):
                w = math.floor(1000 * math.log((2 * total + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                scored.append((-score, i is None, i if i is not None else 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:depth])]
    return sorted(out, key=str)


def corpus(rng, n):
    vocabulary = [f"w{i}" for i in range(300)]
    weights = [1 / (i + 1) for i in range(300)]
    rows = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 80)))) for i in range(n)]
    rows += [(n + i, "Same TEXT w3, w7; w250.") for i in range(40)] + [(n + 50, "same w250 " * 5_000), (3, "w250 Été été"), (None, "w250 w3"), (None, "w250 w3")]
    rows += [(n + 60, None), (n + 61, ""), (n + 62, "?! ..."), (n + 63, "日本語テキスト w9\x00w8")]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 40)))) for i in range(12)]
    items += [(50, " ".join(vocabulary[:150])), (51, None), (52, "..."), (53, "nowhere"), (None, "ÉTÉ Été w250"), (60, "w1"), (60, "W3 w1"), (61, "日本語テキスト")]
    return rows, items


@pytest.mark.parametrize(("depth", "block_terms"), [(50, 50_000), (3, 60), (1, 50_000)])
def test_ranks_equal_all_scores(spark, documents, depth, block_terms, monkeypatch):
    rows, items = corpus(random.Random(depth), 400)
    docs = documents(rows).drop("n_chars")
    asked = spark.createDataFrame([(*r, "x") for r in items], "item_id long, text string, doc_id string").repartition(2)
    got = ranking.rank(docs, asked, depth, block_terms)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted([tuple(r) for r in got.collect()], key=str) == expected(rows, items, depth)


def test_masks_are_left_out_safely():
    """Blocks of any size and any floor below the true border give the same ranks, and fewer documents are evaluated."""
    rng = np.random.default_rng(2)
    chance = 1 / np.arange(1, 41)
    docs = [[(t, int(rng.integers(1, 4))) for t in np.flatnonzero(rng.random(40) < chance)] for _ in range(3000)]
    n = rng.integers(10, 200, 3000)
    weights = np.array([ranking.term_weight(3000, sum(any(t == k for k, _ in d) for d in docs)) for t in range(40)], np.int64)
    items = [np.array([0, 1, 2, 30, 38]), np.arange(40), np.array([39])]

    def run(block, floors, depth=20):
        state = ranking._Search(items, weights, 3000, int(n.sum()), depth, floors)
        for begin in range(0, 3000, block):
            part = range(begin, min(3000, begin + block))
            cells = [(d - begin, t, f) for d in part for t, f in docs[d]]
            owner, term, tf = np.array(cells, np.int64).reshape(-1, 3).T
            state.add(np.array(part), n[part], owner, term, tf)
        return state

    plain = run(3000, np.zeros(3, np.int64), 3000)
    first = [(s[:20], i[:20]) for s, i in plain.best]
    border = np.array([s[-1] if len(s) == 20 else 0 for s, _ in first])
    for state in (run(64, np.zeros(3, np.int64)), run(1000, border), run(7, border // 2)):
        for (s, i), (want_s, want_i) in zip(state.best, first, strict=True):
            assert s.tolist() == want_s.tolist() and i.tolist() == want_i.tolist()
    assert run(1000, border).evaluated < plain.evaluated / 4


def test_masks_group_equal_columns():
    rng = np.random.default_rng(1)
    bitmaps = rng.random((70, 500)) < 0.02
    masks, group = ranking.presence_masks(bitmaps)
    assert (masks[group].T == bitmaps).all() and len({tuple(m) for m in masks}) == len(masks)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranking.rank(documents([(1, "a")]).limit(0), items).count() == 0
    assert ranking.rank(documents([(1, "a")]), items.limit(0)).count() == 0
    assert ranking.rank(documents([(1, None), (2, "b")]), items).count() == 0
