"""Personal data by a semi-Markov conditional random field over candidate segments.

Four plain patterns (``base_spans``) find what is written in the usual way; these spans always stay. They miss what runs
into its neighbours (two card numbers in a row, a phone number followed by an address) or is written otherwise
(``ann [at] mail [dot] org``, a phone number without a plus sign). There the field chooses: every run of digit groups and
every at-sign, in words too, proposes segments of a bounded number of parts with a type, and features of the whole segment
(its digits, grouping, separators, checksum, what stands beside it) give each a score. Scores of neighbouring types are
added. A dynamic programme over the segments' bounds finds the best set of segments that don't overlap, boundaries and
types together, in time proportional to the text. Text outside segments scores 0.

The weights are trained here, on the driver, by conditional likelihood: the gold segments are base spans of a bounded
sample of documents (SAMPLE_DOCS in a seeded order, at most SURFACES spans) and as many made by rule, rewritten and set
beside each other and beside numbers, dates, amounts and codes that are nobody's. The sample's documents give more such
negatives: segments that touch a letter, which are part of a code or word.

Defined results: NULL and empty texts have no spans. Offsets are code points, ends are exclusive. Base spans of different
kinds may overlap; added ones overlap nothing. Rows that repeat an id are scored each. An empty table gives an empty result.
Columns of the input named like a result column are replaced.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.common import documents, stored

KINDS = ("email", "ip", "card", "phone")
SAMPLE_DOCS, SURFACES, EXAMPLES, EPOCHS, SEED = 4_000, 400, 900, 12, 12
LEARNING_RATE, DECAY = 0.3, 1e-3
#: Most digit groups of a segment, and most labels of a host name.
MOST_GROUPS, MOST_LABELS, LOCAL_CHARS = 6, 5, 64

Span = tuple[str, int, int]

# Base patterns. The bounds in front and the possessive repeats only avoid trying places that can't begin a match.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HOST = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CUE = re.compile(r"[0-9@]")
_DIGITS = re.compile(r"[^0-9]")

# Candidates.
_ZONE = re.compile(r"[0-9](?:[\x20().+\[\]-]{0,3}[0-9]++)++")
_GROUP = re.compile(r"[0-9]+")
_AT = re.compile(r"[\x20\t]{0,2}(?:@|[\[({<][\x20]?(?:at|@)[\x20]?[\])}>])[\x20\t]{0,2}|\x20at\x20(?=[A-Za-z0-9-]{1,63}\x20dot\x20)", re.I)
_DOT = re.compile(r"\.|\x20?[\[({<][\x20]?(?:dot|\.)[\x20]?[\])}>]\x20?|\x20dot\x20|\x20?\.\x20", re.I)
_LABEL = re.compile(r"[A-Za-z0-9-]{1,63}")
_IP_JOINS = frozenset((".", "[.]", "(.)", " . "))


def luhn(digits: str) -> bool:
    doubled = (sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (sum(map(int, digits[::-2])) + sum(doubled)) % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    done, at = 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _LOCAL:
            begin -= 1
        host = _HOST.match(text, at + 1) if begin < at else None
        if host:
            done = host.end()
            yield "email", begin, done
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """What the plain patterns find, by start, then kind."""
    if not _CUE.search(text):
        return []
    found = list(_emails(text))
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            found.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            found.append(("phone", m.start(), m.end()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


# --- candidates and their features ---------------------------------------------------------------------------------


def _side(text: str, at: int) -> str:
    """What kind of character stands at a place."""
    if not 0 <= at < len(text):
        return "end"
    c = text[at]
    return "letter" if c.isalpha() else "digit" if c.isdigit() else "space" if c.isspace() else c if c in "+-./:$%#=_(" else "sign"


def _beside(text: str, at: int, step: int) -> str:
    """What stands before or after a segment, and behind one blank."""
    near = _side(text, at)
    return f"{near} {_side(text, at + step)}" if near == "space" else near


def _number_features(kind: str, text: str, begin: int, end: int, groups: list[str], joins: list[str]) -> list[str]:
    digits, shape = sum(map(len, groups)), "-".join(str(len(g)) for g in groups)
    inside = text[begin:end]
    signs = sorted(set("".join(joins)))
    balanced = inside.count("(") == inside.count(")")
    same = "same" if len(set(joins)) <= 1 else "mixed"
    out = [
        "", f"groups {len(groups)}", f"digits {digits}", f"shape {shape}", f"joins {''.join(signs)} {same}", f"balanced {balanced}",
        f"plus {inside[0] == '+'}", f"before {_beside(text, begin - 1, -1)}", f"after {_beside(text, end, 1)}",
        f"longest {max(map(len, groups))}", f"last {len(groups[-1])}",
    ]
    if len(groups) == 3 and {len(groups[0]), len(groups[2])} & {4} and len(groups[1]) <= 2:
        out.append("date")
    return [f"{kind} {f}" for f in out]


def _number_candidates(text: str, zone: re.Match) -> Iterator[tuple[Span, list[str]]]:
    groups = list(_GROUP.finditer(text, zone.start(), zone.end()))
    for i, first in enumerate(groups):
        begin = first.start()
        if text[begin - 1 : begin] == "(":
            begin -= 1
        if begin and text[begin - 1] == "+":
            begin -= 1
        digits, joins = "", []
        for j in range(i, min(i + MOST_GROUPS, len(groups))):
            if j > i:
                joins.append(text[groups[j - 1].end() : groups[j].start()])
                if "+" in joins[-1]:
                    break
            digits += groups[j].group()
            end, parts = groups[j].end(), [g.group() for g in groups[i : j + 1]]
            if len(digits) > 19:
                break
            kinds = []
            if j - i == 3 and set(joins) <= _IP_JOINS and all(len(p) <= 3 and int(p) <= 255 for p in parts):
                kinds.append("ip")
            if "[" not in (joined := "".join(joins)) and "]" not in joined:
                if len(digits) >= 12 and luhn(digits) and "(" not in joined and ")" not in joined:
                    kinds.append("card")
                if 9 <= len(digits) <= 15:
                    kinds.append("phone")
            for kind in kinds:
                start = begin if kind == "phone" else first.start()
                yield (kind, start, end), _number_features(kind, text, start, end, parts, joins)


def _email_candidates(text: str, at: re.Match) -> Iterator[tuple[Span, list[str]]]:
    begin = at.start()
    while begin > max(0, at.start() - LOCAL_CHARS) and text[begin - 1] in _LOCAL:
        begin -= 1
    while begin < at.start() and text[begin] in "._%+-":
        begin += 1
    if begin == at.start():
        return
    form = "word" if at.group().strip().isalpha() else "bracket" if at.group().strip() != "@" else "spaced" if at.group() != "@" else "plain"
    label, dots, labels = _LABEL.match(text, at.end()), [], 0
    while label and labels < MOST_LABELS:
        labels += 1
        end, last = label.end(), label.group()
        if labels > 1:
            capital = dots[-1] == "spaced" and last[:1].isupper()
            tail = ("letters" if last.isalpha() else "other") + str(min(len(last), 7))
            features = [
                "", f"at {form}", f"labels {labels}", f"tail {tail}", f"sentence {capital}", f"after {_beside(text, end, 1)}",
                f"dots {'+'.join(sorted(set(dots)))}", f"at {form} dots {'+'.join(sorted(set(dots)))}",
                f"local {any(c.isalpha() for c in text[begin : at.start()])}", f"before {_beside(text, begin - 1, -1)}",
            ]
            yield ("email", begin, end), [f"email {f}" for f in features]
        dot = _DOT.match(text, end)
        if not dot:
            return
        plain = dot.group().strip()
        dots.append("word" if plain.isalpha() else "bracket" if plain != "." else "plain" if dot.group() == "." else "spaced")
        label = _LABEL.match(text, dot.end())


def candidates(text: str, base: list[Span]) -> Iterator[tuple[Span, list[str]]]:
    """Segments that may be added, each with its features; none overlaps a base span."""
    begins: list[int] = []  # base spans, those that overlap merged
    ends: list[int] = []
    for b, e in sorted((b, e) for _, b, e in base):
        if ends and b < ends[-1]:
            ends[-1] = max(e, ends[-1])
        else:
            begins.append(b)
            ends.append(e)
    sources = [(m.start(), _number_candidates, m) for m in _ZONE.finditer(text) if m.end() - m.start() >= 7]
    sources += [(m.start(), _email_candidates, m) for m in _AT.finditer(text)]
    for _, propose, m in sorted(sources, key=lambda s: s[0]):
        for (kind, b, e), features in propose(text, m):
            k = bisect_right(ends, b)
            if k == len(ends) or begins[k] >= e:
                yield (kind, b, e), features


# --- the field -----------------------------------------------------------------------------------------------------


def _lattice(text: str, spans: list[Span]) -> tuple[list[int], list[bool], dict[int, list[int]]]:
    """Bounds of segments, whether what precedes is still beside a bound, and the segments that end at each bound."""
    points = sorted({p for _, b, e in spans for p in (b, e)})
    beside = [False] + [q - p <= 3 and not any(c.isalnum() for c in text[p:q]) for p, q in zip(points, points[1:], strict=False)]
    at = {p: i for i, p in enumerate(points)}
    ending: dict[int, list[int]] = {}
    for n, (_, _, e) in enumerate(spans):
        ending.setdefault(at[e], []).append(n)
    return points, beside, ending


def _states(text: str, spans: list[Span], scores: list[float], turns: dict[str, float], best: bool):
    """Forward values of (bound, kind of the segment just before, or none), and for ``best`` where each came from."""
    points, beside, ending = _lattice(text, spans)
    at = {p: i for i, p in enumerate(points)}
    values: list[dict[str, float]] = [{"": 0.0}]
    origin: list[dict[str, tuple[int, str, int]]] = [{}]
    for i in range(1, len(points)):
        here: dict[str, list[tuple[float, int, str, int]]] = {}
        for last, value in values[i - 1].items():
            here.setdefault(last if beside[i] else "", []).append((value, i - 1, last, -1))
        for n in ending.get(i, ()):
            kind, b, _ = spans[n]
            for last, value in values[at[b]].items():
                here.setdefault(kind, []).append((value + scores[n] + turns.get(f"{last}>{kind}", 0.0), at[b], last, n))
        now, came = {}, {}
        for kind, ways in here.items():
            top = max(ways, key=lambda w: w[0])
            now[kind] = top[0] if best else top[0] + math.log(sum(math.exp(w[0] - top[0]) for w in ways))
            came[kind] = top[1:]
        values.append(now)
        origin.append(came)
    return points, beside, ending, values, origin


def decode(text: str, spans: list[Span], scores: list[float], turns: dict[str, float]) -> list[Span]:
    """The best set of segments that don't overlap."""
    if not spans:
        return []
    *_, values, origin = _states(text, spans, scores, turns, True)
    i, last, out = len(values) - 1, max(values[-1], key=values[-1].get), []
    while i > 0:
        i, last, n = origin[i][last]
        if n >= 0:
            out.append(spans[n])
    return out[::-1]


def expectations(text: str, spans: list[Span], scores: list[float], turns: dict[str, float]) -> tuple[float, list[float], Counter]:
    """Log of the total weight, the probability of each segment, and the expected number of each pair of kinds."""
    points, beside, ending, forward, _ = _states(text, spans, scores, turns, False)
    at = {p: i for i, p in enumerate(points)}
    total = max(forward[-1].values())
    total += math.log(sum(math.exp(v - total) for v in forward[-1].values()))
    backward: list[dict[str, float]] = [{} for _ in points]
    backward[-1] = dict.fromkeys(forward[-1], 0.0)
    likely, pairs = [0.0] * len(spans), Counter()
    starting: dict[int, list[int]] = {}
    for n, (_, b, _) in enumerate(spans):
        starting.setdefault(at[b], []).append(n)
    for i in range(len(points) - 2, -1, -1):
        for last, value in forward[i].items():
            ways = [backward[i + 1][last if beside[i + 1] else ""]]
            for n in starting.get(i, ()):
                kind, _, e = spans[n]
                way = scores[n] + turns.get(f"{last}>{kind}", 0.0) + backward[at[e]][kind]
                ways.append(way)
                chance = math.exp(value + way - total)
                likely[n] += chance
                pairs[f"{last}>{kind}"] += chance
            top = max(ways)
            backward[i][last] = top + math.log(sum(math.exp(w - top) for w in ways))
    return total, likely, pairs


def _pairs_of(text: str, spans: list[Span], chosen: set[int]) -> Counter:
    """Pairs of kinds along the gold segments."""
    points, beside, _ = _lattice(text, spans)
    at = {p: i for i, p in enumerate(points)}
    pairs, last, place = Counter(), "", 0
    for n in sorted(chosen, key=lambda n: spans[n][1]):
        kind, b, e = spans[n]
        if not all(beside[place + 1 : at[b] + 1]):
            last = ""
        pairs[f"{last}>{kind}"] += 1
        last, place = kind, at[e]
    return pairs


def train(examples: list[tuple[str, list[Span]]], epochs: int = EPOCHS, seed: int = SEED) -> dict[str, float]:
    """Weights of features and of pairs of kinds (``email>phone``), by ascent of the conditional likelihood."""
    ready = []
    for text, gold in examples:
        rows = list(candidates(text, []))
        spans = [s for s, _ in rows]
        if rows and set(gold) <= set(spans):
            ready.append((text, spans, [f for _, f in rows], {spans.index(g) for g in gold}))
    weights: Counter = Counter()
    speed: Counter = Counter()
    rng = random.Random(seed)
    for _ in range(epochs):
        rng.shuffle(ready)
        for text, spans, features, gold in ready:
            scores = [sum(weights[f] for f in fs) for fs in features]
            _, likely, expected = expectations(text, spans, scores, weights)
            slope = _pairs_of(text, spans, gold)
            slope.subtract(expected)
            for n, fs in enumerate(features):
                gain = (n in gold) - likely[n]
                for f in fs:
                    slope[f] += gain
            for f, g in slope.items():
                g -= DECAY * weights[f]
                speed[f] += g * g
                if g:
                    weights[f] += LEARNING_RATE * g / math.sqrt(speed[f] + 1e-8)
    return {f: w for f, w in weights.items() if w}


# --- training texts ------------------------------------------------------------------------------------------------


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _made(rng: random.Random, kind: str) -> str:
    """A usual spelling of each kind, made by rule."""
    if kind == "email":
        word = lambda: "".join(rng.choices("abcdefghilmnoprstuv", k=rng.randint(2, 9)))
        return f"{word()}{rng.choice(['', '.' + word(), _digits(rng, 2)])}@{word()}.{rng.choice(['com', 'org', 'net', 'de', 'co.uk', word() + '.io'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == "card":
        while not luhn(digits := str(rng.randint(3, 6)) + _digits(rng, rng.choice((14, 15, 15, 15, 15)))):
            pass
        return digits
    return rng.choice(("+{a} ({b}) {c}-{d}", "+{a}-{b}-{c}-{d}", "+{a} {b} {c} {d}", "+{a}.{b}.{c}.{d}")).format(
        a=rng.randint(1, 99), b=_digits(rng, 3), c=_digits(rng, 3), d=_digits(rng, 4)
    )


def _rewritten(rng: random.Random, kind: str, surface: str) -> str:
    """A spelling that the base patterns may miss."""
    if kind == "email":
        local, host = surface.split("@", 1)
        style = rng.randrange(5)
        at, dot = ((" @ ", "."), ("(at)", "."), ("[at]", "[dot]"), (" (at) ", " (dot) "), (" at ", " dot "))[style]
        return local + at + host.replace(".", dot)
    if kind == "ip":
        return surface.replace(".", rng.choice((".", "[.]", "(.)")))
    groups = _GROUP.findall(surface)
    if kind == "card":
        digits, size = "".join(groups), rng.choice((4, 4, 19))
        return rng.choice(" -. ").join(digits[i : i + size] for i in range(0, len(digits), size))
    if rng.random() < 0.3:
        return surface
    groups = groups[1:] if len(groups) > 3 and sum(map(len, groups[1:])) >= 9 and rng.random() < 0.6 else groups
    if rng.random() < 0.4 and len(groups) > 2:
        return f"({groups[0]}) " + rng.choice(" -.").join(groups[1:])
    return rng.choice(" -.").join(groups)


def _nothing(rng: random.Random) -> str:
    """Numbers and at-signs that are nobody's data."""
    year, n = rng.randint(1900, 2030), rng.randint(1, 28)
    run = lambda: rng.choice((" ", ". ", "-", "  ")).join(_digits(rng, rng.randint(1, 4)) for _ in range(rng.randint(2, 9)))
    def unchecked() -> str:
        while luhn(digits := _digits(rng, rng.randint(12, 19))):
            pass
        return digits
    return rng.choice(
        (
            lambda: f"{year}-{n:02}-{rng.randint(1, 12):02} {n}", lambda: f"{n}.{rng.randint(1, 12)}.{year} - {n}.{rng.randint(1, 12)}.{year + 1}",
            lambda: f"{year}-{year + 1} {year + 2}", lambda: _digits(rng, rng.randint(1, 11)), unchecked, run, run,
            lambda: f"978-{n % 10}-{_digits(rng, 2)}-{_digits(rng, 6)}-{n % 10}", lambda: f"{n}.{_digits(rng, 2)} {n}.{_digits(rng, 2)} {n}.{_digits(rng, 3)}",
            lambda: f"{n} {_digits(rng, 3)} {_digits(rng, 3)} {_digits(rng, 3)}", lambda: f"{n}.{n}.{n}-{_digits(rng, 4)}", lambda: f"x{_digits(rng, 12)}f",
            lambda: f"{n} @ {n}.{_digits(rng, 2)} each", lambda: "was (at) home. Then we", lambda: "look @ this. And that", lambda: f"v{n}.{n}.{n}.{300 + n}",
        )
    )()


def training_examples(windows: list[tuple[str, list[Span]]], count: int = EXAMPLES, seed: int = SEED) -> list[tuple[str, list[Span]]]:
    """Texts with gold segments. ``windows`` are pieces of the sample's texts with their base spans, or none."""
    rng = random.Random(seed)
    seen: dict[str, list[str]] = {k: [] for k in KINDS}
    for text, base in windows:
        for kind, b, e in base:
            seen[kind].append(text[b:e])
    out = [(text, []) for text, base in windows if not base]
    for _ in range(count):
        text, gold = rng.choice(("", "to ", "und ", "le: ")), []
        for place in range(rng.choice((1, 1, 2, 2, 3))):
            if place:
                text += rng.choice((" ", " ", " ", ", ", " - ", " / ", " et ", ". "))
            if rng.random() < 0.4:
                text += _nothing(rng)
                continue
            kind = rng.choice(KINDS)
            surface = rng.choice(seen[kind]) if seen[kind] and rng.random() < 0.5 else _made(rng, kind)
            surface = _rewritten(rng, kind, surface) if rng.random() < 0.6 else surface
            gold.append((kind, len(text), len(text) + len(surface)))
            text += surface
        out.append((text + rng.choice(("", " of", ".", ", the", " 12")), gold))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Base spans, and short pieces of text around candidates that touch a letter."""
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            base = base_spans(text or "")
            for kind, b, e in base:
                rows.append((doc_id, b, text[b:e], kind))
            for (_, b, e), _ in candidates(text or "", base):
                if "letter" in (_side(text, b - 1), _side(text, e)):
                    rows.append((doc_id, b, text[max(0, b - 12) : e + 12], None))
        columns = zip(*rows, strict=True) if rows else ([], [], [], [])
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], ["doc_id", "at", "piece", "kind"]
        )


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, surfaces: int = SURFACES) -> dict[str, float]:
    """Weights from at most ``surfaces`` pieces of each sort out of ``sample_docs`` documents."""
    order = [F.xxhash64("doc_id", F.lit(SEED)), F.col("doc_id")]
    ids = stored(docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long")).orderBy(*order).limit(sample_docs).distinct(), "sample")
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).join(F.broadcast(ids), "doc_id", "left_semi")
    found = stored(texts.mapInArrow(_windows, "doc_id long, at long, piece string, kind string"), "windows")
    rows = []
    for sort in (F.col("kind").isNull(), F.col("kind").isNotNull()):
        rows += found.filter(sort).orderBy(*order, "at", "piece", "kind").limit(surfaces).collect()
    windows = [(r["piece"], [(r["kind"], 0, len(r["piece"]))] if r["kind"] else []) for r in rows]
    return train(training_examples(windows))


# --- the operator --------------------------------------------------------------------------------------------------


def find(text: str, weights: dict[str, float]) -> list[tuple[str, int, int, bool]]:
    """All spans of a text, by start, then kind; whether each is a base span."""
    base = base_spans(text)
    spans, scores = [], []
    for span, features in candidates(text, base):
        spans.append(span)
        scores.append(sum(weights.get(f, 0.0) for f in features))
    added = decode(text, spans, scores, weights)
    every = [(*s, True) for s in base] + [(*s, False) for s in added]
    return sorted(every, key=lambda s: (s[1], KINDS.index(s[0])))


_SPANS = T.ArrayType(
    T.StructType(
        [
            T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
            T.StructField("base", T.BooleanType()),
        ]
    )
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def find_personal_data(docs: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``docs`` with ``spans``: an array of (kind, start, end, base)."""
    docs = docs.drop("spans")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("kind", "start", "end", "base")
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).cast(pa.string()).to_pylist()
            found = [[dict(zip(names, s, strict=True)) for s in find(t or "", weights)] for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, _ARROW_SPANS)], [*batch.schema.names, "spans"])

    return docs.mapInArrow(scan, T.StructType([*docs.schema.fields, T.StructField("spans", _SPANS)]))


def written_spans(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = find_personal_data(docs, fit(docs))
    base = F.filter("spans", lambda s: s["base"])
    kinds = F.transform(base, lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(written_spans(base).cast("binary"), 256).alias("base_sha256"), written_spans(F.col("spans")).alias("spans"))
