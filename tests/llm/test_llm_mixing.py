import random
import re

import pytest

from roadpulse.llm.common import WORD
from roadpulse.llm.mixing import mix

SIZE = re.compile(WORD)


def water_fill(sizes: dict, cap: int = 3) -> dict:
    """Round by round, as the contract says it."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, capped = sum(sizes.values()), {}, set()
    while True:
        left = total - sum(cap * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        weights = sum(weight[s] for s in open_)
        target = {s: cap * sizes[s] if s in capped else left * weight[s] / weights for s in order}
        over = {s for s in open_ if target[s] > cap * sizes[s]}
        if not over:
            return target
        capped |= over


def rows_of(seed: int = 1):
    rng = random.Random(seed)
    sources = ["a", "b", "B", "é", "", None, "zz", "src10", "src2"]
    weights = [50, 3, 1, 8, 2, 5, 1, 20, 9]
    rows = [(i, " ".join("x" * rng.randint(1, 40)), "en", rng.choices(sources, weights)[0]) for i in range(900)]
    return [*rows, (900, None, "en", "a"), (901, "", "en", "only blank"), (902, "\x0b \x1f", "en", "zz"), (None, "a b", "en", "b")]


def test_targets_and_shares(documents):
    rows = rows_of()
    got = mix(documents(rows)).collect()
    assert len(got) == len(rows)
    sizes: dict = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(SIZE.findall(text or ""))
    targets, taken = water_fill(sizes), dict.fromkeys(sizes, 0)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(targets[r["source"]])
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        taken[r["source"]] += r["taken"]
    for source in sizes:
        assert abs(taken[source] - targets[source]) <= 20  # half of the largest document
    again = mix(documents(rows[::-1])).collect()
    key = lambda r: (str(r["doc_id"]), r["taken"])
    assert sorted(again, key=key) == sorted(got, key=key)


def test_nothing_to_mix(documents):
    assert mix(documents([])).count() == 0
    got = mix(documents([(1, None, "en", "a"), (2, " ", "en", None)])).collect()
    assert {(r["size"], r["target"], r["taken"]) for r in got} == {(0, 0.0, 0)}


def test_repeated_rows_count_each(documents):
    got = mix(documents([(1, "a b c", "en", "s")] * 4)).collect()
    assert [r["taken"] for r in got] == [3] * 4
