import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from roadpulse.llm import words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
ALPHABET = "ab AB\t\n\x1fé日"


def _all(texts):
    hashes, at = [], [0]
    for _, _, data, starts in words.runs(pa.array(texts, pa.string())):
        found, where = words.hash_words(data, starts)
        at += (where[1:] + len(hashes)).tolist()
        hashes += found.tolist()
    return hashes, at


@settings(max_examples=200, deadline=None)
@given(st.lists(st.none() | st.text(ALPHABET, max_size=20), max_size=8), st.sampled_from([1, 5, 1 << 20]))
def test_words_of_runs(texts, run_bytes):
    before, words.RUN_BYTES = words.RUN_BYTES, run_bytes
    try:
        hashes, at = _all(texts)
    finally:
        words.RUN_BYTES = before
    want = [[w.lower() for w in WORD.findall((t or "").encode())] for t in texts]
    assert [b - a for a, b in zip(at, at[1:], strict=False)] == [len(w) for w in want]
    flat = [w for each in want for w in each]
    assert len(set(zip(flat, hashes, strict=True))) == len(set(flat)) == len(set(hashes))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("ab ", max_size=24), min_size=1, max_size=5))
def test_shingles(texts):
    offsets = np.cumsum([0, *map(len, texts)])
    hashes, starts = words.hash_words(np.frombuffer("".join(texts).encode(), np.uint8), offsets)
    out, at = words.shingles(hashes, starts, 3)
    seen: dict = {}
    for k, text in enumerate(texts):
        tokens = tuple(text.split())
        want = [tokens[i : i + 3] for i in range(len(tokens) - 2)] or ([tokens] if tokens else [])
        got = out[at[k] : at[k + 1]].tolist()
        assert len(got) == len(want)
        for shingle, value in zip(want, got, strict=True):
            assert seen.setdefault(shingle, value) == value
    assert len(set(seen.values())) == len(seen)
