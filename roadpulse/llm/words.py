"""Words of many texts at once, as hashes in numpy arrays. Used inside tasks by several operators.

A word is a run of anything but the six ASCII white-space characters, with A-Z lower-cased. Both work on UTF-8 bytes,
since none of these bytes is part of a longer character. The 64-bit hash of a word is a polynomial over its bytes,
modulo 2**64, taken as a difference of prefix sums; so no loop runs over words or characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Texts are handled in runs of about this many bytes, which bounds the memory of a task; one longer text is a run.
RUN_BYTES = 1 << 20

_RNG = np.random.default_rng(20240501)
_VALUE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE[65:91] = _VALUE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE, _INVERSE = np.uint64(0x9E3779B97F4A7C15), np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse; those of a usual run are kept, those of a longer text are not."""
    if _powers and n <= len(_powers[0]):
        return _powers
    made = []
    for base in (_BASE, _INVERSE):
        steps = np.full(max(n, RUN_BYTES + 1), base, np.uint64)
        steps[0] = 1
        made.append(np.multiply.accumulate(steps))
    if n <= RUN_BYTES + 1:
        _powers[:] = made
    return made


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, start of each text and the end of the last) for runs of whole texts; NULL is empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    begin = 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + RUN_BYTES, "right")) - 1)
        yield begin, end, data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
        begin = end


def word_spans(
    data: np.ndarray, starts: np.ndarray, space: np.ndarray = _SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words, where each text's words start (with the end of the last), and the words' bytes' bounds."""
    n = len(data)
    if not n:
        return np.empty(0, np.uint64), np.zeros(len(starts), np.int64), *np.empty((2, 0), np.int64)
    black = ~space[data]
    edge = np.zeros(n + 1, bool)
    edge[starts] = True
    begins = black.copy()
    begins[1:] &= ~black[:-1] | edge[1:n]
    ends = black
    ends[:-1] &= ~black[1:] | edge[1:n]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    power, inverse = _power(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[data] * power[:n], out=sums[1:])
    hashes = mixed((sums[end] - sums[begin]) * inverse[begin])
    return hashes, np.searchsorted(begin, starts), begin, end


def hash_words(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words start (with the end of the last)."""
    return word_spans(data, starts)[:2]


def shingles(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every run of ``size`` words within a text, and where each text's start.

    A text with fewer words, but any, has one shingle of all its words.
    """
    counts = np.diff(starts)
    joined = np.zeros(max(0, len(hashes) - size + 1), np.uint64)
    for i in range(size):
        joined = joined * _BASE + hashes[i : i + len(joined)]
    have = np.maximum(counts - size + 1, (counts > 0).astype(np.int64))
    out_starts = np.concatenate(([0], np.cumsum(have)))
    out = np.empty(out_starts[-1], np.uint64)
    long = np.flatnonzero(counts >= size)
    if len(long):
        keep = np.zeros(len(joined) + 1, np.int64)
        np.add.at(keep, starts[long], 1)
        np.add.at(keep, starts[long] + have[long], -1)
        target = np.zeros(len(out) + 1, np.int64)
        np.add.at(target, out_starts[long], 1)
        np.add.at(target, out_starts[long] + have[long], -1)
        out[np.cumsum(target)[:-1] > 0] = mixed(joined[np.cumsum(keep)[:-1] > 0])
    for row in np.flatnonzero((counts > 0) & (counts < size)):
        value = np.uint64(counts[row])
        with np.errstate(over="ignore"):
            for word in hashes[starts[row] : starts[row + 1]]:
                value = value * _INVERSE + word
        out[out_starts[row]] = mixed(np.array([value]))[0]
    return out, out_starts
