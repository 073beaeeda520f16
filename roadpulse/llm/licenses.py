"""License scans: winnowed fingerprints pick candidates, banded alignment measures them.

Templates and texts are sequences of tokens, runs of ASCII letters and digits (lower-cased) and of other characters.
Of each template's GRAM-token hashes those that are the least of a window of WINDOW are kept, in an inverted index
(hash -> template and place). All hashes of a text are looked up there, so that any GRAM + WINDOW - 1 tokens in common
are found. Hits of one template that follow each other in the text and in the template are chained, each to the best chain
before it, over insertions and deletions of up to WIDEST_GAP tokens. A chain's stretch of the text is aligned with the whole template in a band around
its diagonals (match +2, anything else -1, best local alignment); coverage is the share of the template's tokens that
match. Of overlapping matches the one with more matching tokens stays, then the higher coverage, the earlier one, the
first name.

What tells a license from its siblings (name, version, BY, NC, SA, Affero, Lesser) must match exactly: each run of
tokens that DECISIVE lists for a template has to lie in one piece in the match. Siblings are templates themselves.

The templates are a fixed set that the caller may replace, with its own decisive runs; the index goes to the tasks as it is.

Defined results: NULL and empty texts have no match. A match's span is in characters, from the first to behind the last
matching token. An empty table gives an empty result. Texts are read in full, whatever their length.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadpulse.llm.common import documents
from roadpulse.llm.words import mixed, runs, word_spans

GRAM, WINDOW = 3, 3
LEAST_COVERAGE = 0.75
WIDEST_BAND = 8
MATCH, OTHER = 2, -1

# Wording of common license notices. Fixed values.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-2.0-line": "This work is licensed under the GNU General Public License, version 2.",
    "lgpl-3.0-line": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-2.1-line": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "agpl-3.0-line": "This work is licensed under the GNU Affero General Public License, version 3.",
    "apache-1.1-line": "Licensed under the Apache License, Version 1.1.",
    "cc-by-4.0-line": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-sa-4.0-line": "Licensed under CC BY-NC-SA 4.0.",
    "cc-by-nc-nd-4.0-line": "Licensed under CC BY-NC-ND 4.0.",
    "all-rights-reserved": "All rights reserved.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the "
        "Software."
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "bsd-3-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission."
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        "\"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."
    ),
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version."
    ),
    "bsd-2-clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution."
    ),
    **{name: (
        f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General "
        f"Public License as published by the Free Software Foundation, either version {version} of the License, or (at your "
        "option) any later version."
    ) for name, kind, version in (
        ("gpl-2.0", "", "2"), ("lgpl-3.0", "Lesser ", "3"), ("lgpl-2.1", "Lesser ", "2.1"), ("agpl-3.0", "Affero ", "3"),
    )},
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."
    ),
}

#: Runs of tokens that a match of a template must have.
DECISIVE = {
    "mit-line": ["MIT License"],
    "apache-2.0-line": ["Apache License", "Version 2.0"],
    "apache-1.1-line": ["Apache License", "Version 1.1"],
    "apache-2.0": ["Apache License", "Version 2.0"],
    "cc-by-nc-4.0-line": ["CC BY NC 4.0"],
    "cc-by-4.0-line": ["CC BY 4.0"],
    "cc-by-sa-4.0-line": ["CC BY SA 4.0"],
    "cc-by-nc-sa-4.0-line": ["CC BY NC SA 4.0"],
    "cc-by-nc-nd-4.0-line": ["CC BY NC ND 4.0"],
    "bsd-3-clause": ["endorse or promote"],
    "mpl-2.0": ["Mozilla Public License", "2.0"],
    **{
        f"{short}-{version}{line}": [f"GNU {kind}General Public License", f"version {version.removesuffix('.0')}"]
        for short, kind, versions in (
            ("gpl", "", ("2.0", "3.0")), ("lgpl", "Lesser ", ("2.1", "3.0")), ("agpl", "Affero ", ("3.0",)),
        )
        for version in versions for line in ("", "-line")
    },
}

_BREAK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_MATCHES = "doc_id long, license string, coverage double, matched int, span_start int, span_end int"


def tokens_of(text: str) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return word_spans(data, np.array([0, len(data)]), _BREAK)[0]


_ZERO = tokens_of("0")[0]


def joined_numbers(data: np.ndarray, first: np.ndarray, last: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
    """Which tokens, given by their bytes' bounds, a dot alone parts from the next, both being numbers there.

    ``at`` tells where each text's tokens start, if there are several texts; no token is joined to one of the next text.
    """
    out = np.zeros(len(first), bool)
    if len(first) > 1:
        digit = (data >= 48) & (data <= 57)
        after = np.minimum(last[:-1], len(data) - 1)
        out[:-1] = (first[1:] == last[:-1] + 1) & (data[after] == 46) & digit[last[:-1] - 1] & digit[first[1:]]
    if at is not None:
        out[at[at > 0] - 1] = False
    return out


def grams(tokens: np.ndarray) -> np.ndarray:
    n = max(0, len(tokens) - GRAM + 1)
    out = np.zeros(n, np.uint64)
    for i in range(GRAM):
        out = mixed(out + tokens[i : i + n])
    return out


def winnow(hashes: np.ndarray) -> list[int]:
    """Places of the least hash (the last of equals) of every window, or of all hashes if they are fewer."""
    if len(hashes) <= WINDOW:
        return [len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else []
    windows = np.lib.stride_tricks.sliding_window_view(hashes, WINDOW)[:, ::-1]
    return sorted(set((np.arange(len(windows)) + WINDOW - 1 - windows.argmin(1)).tolist()))


class Index:
    """Fingerprints of the templates, sorted, with the template and place of each."""

    def __init__(self, templates: dict[str, str], decisive: dict[str, list[str]] | None = None) -> None:
        self.names = sorted(templates)
        decisive = (DECISIVE if templates is TEMPLATES else {}) if decisive is None else decisive
        self.decisive = [[tokens_of(run).tolist() for run in decisive.get(x, ())] for x in self.names]
        self.tokens = [tokens_of(templates[x]) for x in self.names]
        entries = []
        for t, tokens in enumerate(self.tokens):
            hashes = grams(tokens)
            entries += [(int(hashes[p]), t, p) for p in winnow(hashes)]
        entries.sort()
        self.hashes = np.array([e[0] for e in entries], np.uint64)
        self.where = [(t, p) for _, t, p in entries]
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[(self.hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def decided(self, t: int, tokens: np.ndarray, begin: int, end: int, joined: np.ndarray) -> bool:
        """Whether the matched tokens have every decisive run of the template.

        ``joined`` marks tokens that a dot joins to the number that follows. A run that ends in the middle of a version
        doesn't count: "version 3" is not in "version 3.1", but it is in "version 3.0".
        """

        def whole(last: int) -> bool:
            while last < len(joined) and joined[last]:
                last += 1
                if tokens[last] != _ZERO:
                    return False
            return True

        places = {run[0]: np.flatnonzero(tokens[begin:end] == np.uint64(run[0])) + begin for run in self.decisive[t]}
        return all(
            any(i + len(run) <= end and tokens[i : i + len(run)].tolist() == run and whole(i + len(run) - 1) for i in places[run[0]])
            for run in self.decisive[t]
        )

    def hits(self, hashes: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place in the hashes, template, place in the template)."""
        for place in np.flatnonzero(self.sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)]):
            first = np.searchsorted(self.hashes, hashes[place], "left")
            while first < len(self.hashes) and self.hashes[first] == hashes[place]:
                yield int(place), *self.where[first]
                first += 1


def band_of(template: np.ndarray) -> int:
    return min(WIDEST_BAND, len(template) // 4)


def align(template: np.ndarray, text: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """(matching tokens, first, end) of the best local alignment on diagonals low..high (place in text - in template).

    Of equal scores the one with more matches wins, then the one that ends first, then that which starts first.
    """
    width = high - low + 1
    empty = (0, 0, 0, 0)
    best = empty
    above = [empty] * (width + 1)  # (score, matches, -start, -end), by diagonal; the last is a border
    for i, token in enumerate(template):
        row = [empty] * (width + 1)
        for d in range(width):
            j = i + low + d
            if not 0 <= j < len(text):
                continue
            score, n, start, _ = above[d]
            equal = text[j] == token
            if score <= 0:
                score, n, start = 0, 0, -j
            options = [(score + (MATCH if equal else OTHER), n + int(equal), start)]
            left, up = row[d - 1] if d else empty, above[d + 1]
            options += [(s + OTHER, m, b) for s, m, b, _ in (left, up)]
            score, n, start = max(options)
            if score > 0:
                row[d] = (score, n, start, -(j + 1) if equal else 0)
                if equal and row[d] > best:
                    best = row[d]
        above = row
    return best[1], -best[2], -best[3]


def chains(hits: list[tuple[int, int]], length: int) -> list[list[int]]:
    """Chains [value, first place, last place, last place in the template, least and greatest diagonal], best first.

    ``hits`` are the (place in text, in template) of one template. A hit continues the most valuable chain before it in
    both that is worth more than the tokens put in or left out between them, each of which costs one as in the
    alignment, and which others may continue too; if there is none, it begins one. A chain is worth MATCH * ``length`` at most, so
    that a hit meets only the chains of the last places.
    """
    done: list[list[int]] = []
    live: list[list[int]] = []
    for place, p in sorted(hits):
        oldest, diagonal = place - (1 + MATCH) * length, place - p
        done += [c for c in live if c[2] < oldest]
        live = [c for c in live if c[2] >= oldest]
        best = None
        for c in live:
            jump = abs(diagonal - c[2] + c[3])
            if c[2] < place and c[3] < p and jump < c[0] and (best is None or (c[0] - jump, -jump) > best[0]):
                best = (c[0] - jump, -jump), c
        if best is None:
            live.append([MATCH * GRAM, place, place, p, diagonal, diagonal])
            continue
        (value, jump), c = best
        value = min(value + MATCH * min(GRAM, place - c[2], p - c[3]), MATCH * length)
        longer = [value, c[1], place, p, min(c[4], diagonal), max(c[5], diagonal)]
        if jump:
            live.append(longer)
        else:
            c[:] = longer
    return sorted(done + live, key=lambda c: (-c[0], c[1:]))


def scan_tokens(
    tokens: np.ndarray, hits: list[tuple[int, int, int]], index: Index, least: float, joined: np.ndarray
) -> list[tuple[int, float, int, int, int]]:
    """(template, coverage, matching tokens, first token, end token) of the matches of one text, without overlaps.

    ``joined`` is ``joined_numbers`` of the text.
    """
    by_template: dict[int, list[tuple[int, int]]] = {}
    for place, t, p in hits:
        by_template.setdefault(t, []).append((place, p))
    found = []
    for t, places in by_template.items():
        template, band = index.tokens[t], band_of(index.tokens[t])
        spans: dict[int, list[tuple[int, int]]] = {}  # aligned spans of the text by blocks of it
        size = (1 + MATCH) * len(template)
        for _, begin, last, _, low, high in chains(places, len(template)):
            near = range(begin // size, last // size + 1)
            if any(x <= begin and last < y for k in near for x, y in spans.get(k, ())):
                continue
            base = max(0, low - band)
            stretch = tokens[base : high + band + len(template)]  # as wide as the chain's gaps
            n, first, end = align(template, stretch, low - band - base, high + band - base)
            if n >= least * len(template) and index.decided(t, tokens, base + first, base + end, joined):
                found.append((t, n / len(template), n, base + first, base + end))
                for k in range((base + first) // size, (base + end) // size + 1):
                    spans.setdefault(k, []).append((base + first, base + end))
    kept: list[tuple[int, int, tuple]] = []  # by place; they don't overlap, so that only two neighbours matter
    for match in sorted(found, key=lambda m: (-m[2], -m[1], m[3], m[0])):
        at = bisect_left(kept, (match[3],))
        if (at == 0 or kept[at - 1][1] <= match[3]) and (at == len(kept) or match[4] <= kept[at][0]):
            kept.insert(at, (match[3], match[4], match))
    return [match for _, _, match in kept]


def _scanner(shared, least: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for batch in batches:
            rows = []
            for begin, end, data, starts in runs(batch.column(1)):
                tokens, at, first, last = word_spans(data, starts, _BREAK)
                joined = joined_numbers(data, first, last, at)
                by_text: dict[int, list] = {}
                for place, t, p in index.hits(grams(tokens)):
                    text = int(np.searchsorted(at, place, "right")) - 1
                    if place + GRAM <= at[text + 1]:
                        by_text.setdefault(text, []).append((place - int(at[text]), t, p))
                for text, hits in by_text.items():
                    own = slice(int(at[text]), int(at[text + 1]))
                    id_ = batch.column(0)[begin + text].as_py()
                    for t, coverage, n, x, y in scan_tokens(tokens[own], hits, index, least, joined[own]):
                        span = (int(starts[text]), int(first[own][x]), int(last[own][y - 1]))
                        lengths = [len(data[span[0] : s].tobytes().decode()) for s in span[1:]]
                        rows.append((id_, index.names[t], coverage, n, *lengths))
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            types = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int32()]
            names = ["doc_id", "license", "coverage", "matched", "span_start", "span_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, types, strict=True)], names)

    return scan


def scan_licenses(
    docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST_COVERAGE, decisive: dict[str, list[str]] | None = None
) -> DataFrame:
    """(doc_id, license, coverage, matched, span_start, span_end), a row for each match."""
    shared = docs.sparkSession.sparkContext.broadcast(Index(templates or TEMPLATES, decisive))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(_scanner(shared, least), _MATCHES)


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(documents(spark, sf_dir))
