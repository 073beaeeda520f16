"""Exact and near dedup, components, and the Bloom filter helpers."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from roadpulse.llm import common, near_dedup
from roadpulse.llm.components import components
from roadpulse.llm.exact_dedup import exact_dedup

ASCII = str.maketrans(common.UPPER, common.LOWER)
WORD = re.compile(common.WORD)


def texts(seed: int = 4):
    """Documents with exact copies, near copies, chains of near copies, a large wide group, blanks and a long text."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefgh") + str(rng.randint(0, 400))
    rows = [None, None, "", " \t\n", "One two", "one TWO", "one  two", "One two three four five", "é É", "É É"]
    base = [word() for _ in range(60)]
    rows += [" ".join(base)] * 3
    for _ in range(150):  # a wide group: some members are linked to the base, some to no one
        changed = list(base)
        for _ in range(rng.randint(0, 6)):
            changed[rng.randrange(60)] = word()
        rows.append(" ".join(changed))
    chain = [word() for _ in range(100)]
    for k in range(10):
        chain[k * 9] = word()
        rows.append(" ".join(chain))
    rows += [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(60)]
    rows.append(" ".join(word() for _ in range(40_000)))
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_exact_dedup(documents):
    rows = [*texts(), (None, "One two"), (None, "only without id"), (3, "a twin"), (3, "a twin")]
    got = exact_dedup(documents(rows).withColumn("kept", F.lit("clash"))).collect()
    groups: dict[str, list] = {}
    for i, text in rows:
        groups.setdefault((text or "").translate(ASCII), []).append(i)
    want = []
    for i, text in rows:
        plain = (text or "").translate(ASCII)
        keep = max((x for x in groups[plain] if x is not None), default=None)
        want.append((i, keep, len(groups[plain]), i == keep, hashlib.sha256(plain.encode()).hexdigest()))
    key = lambda row: tuple(map(str, row))
    found = [(r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got]
    assert sorted(found, key=key) == sorted(want, key=key)
    assert {"lang", "source", "n_chars"} <= set(got[0].asDict())


def test_exact_dedup_with_a_saturated_filter(documents, monkeypatch):
    """A filter that lets everything through changes nothing."""
    rows = texts()
    want = sorted(tuple(r) for r in exact_dedup(documents(rows)).select("doc_id", "keep_id", "group_size", "kept").collect())
    monkeypatch.setattr("roadpulse.llm.exact_dedup.filter_bits", lambda items: 64)
    got = sorted(tuple(r) for r in exact_dedup(documents(rows)).select("doc_id", "keep_id", "group_size", "kept").collect())
    assert got == want


def test_empty_table(documents):
    assert exact_dedup(documents([])).count() == 0
    assert near_dedup.near_dedup(documents([])).count() == 0


def test_filters_by_id(spark):
    rows = spark.range(0, 5000).withColumnRenamed("id", "doc_id")
    ids = common.stored(rows.filter("doc_id % 7 = 3"), "ids")
    assert {r[0] for r in common.pick(rows, ids, "doc_id").collect()} == set(range(3, 5000, 7))
    left = rows.union(spark.createDataFrame([(None,)], "doc_id long"))
    got = [r[0] for r in common.without(left, ids, "doc_id").collect()]
    assert sorted(got, key=str) == sorted([*(i for i in range(5000) if i % 7 != 3), None], key=str)


def test_groups_join_hot_and_cold_alike(spark):
    rows = spark.range(0, 9000).selectExpr("id", "case when id % 3 = 0 then 'hot' else cast(id % 400 as string) end AS k")
    groups = common.stored(rows.groupBy("k").agg(F.count("*").alias("n")), "groups")
    got = common.join_groups(rows, groups, "k", "n", 9000)
    assert got.count() == 9000 and got.filter("k = 'hot' AND n <> 3000").count() == 0


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 470)]
    links += [(900, i) for i in range(901, 980)] + [(7, 7)]
    parent = list(range(1000))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    nodes = {x for a, b in links if a != b for x in (a, b)}
    assert got == {x: find(x) for x in nodes}


def shingle_set(text):
    words = WORD.findall((text or "").translate(ASCII))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute_force(rows):
    sets = {i: shingle_set(t) for i, t in rows}
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            shared = len(sets[a] & sets[b])
            if shared and 100 * shared >= 75 * (len(sets[a]) + len(sets[b]) - shared):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


@pytest.mark.parametrize("listed", [2, 32])
def test_near_dedup(documents, monkeypatch, listed):
    """Equal to comparing all pairs, whether large buckets are compared in blocks or listed."""
    monkeypatch.setattr(near_dedup, "LISTED", listed)
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 40)
    rows = texts()
    got = near_dedup.near_dedup(documents(rows)).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in got} == brute_force(rows)


def test_least_matches_bound_the_miss():
    import math

    for n in (32, 64, 128):
        m = near_dedup.least_matches(n)
        tail = lambda k: sum(math.comb(n + 1, i) * 0.75**i * 0.25 ** (n + 1 - i) for i in range(k + 1))
        assert tail(m) >= near_dedup.MISS > tail(m - 1)
