"""Document fingerprints as invertible Bloom lookup sketches of paragraphs.

A text's paragraphs are its lines, cut after sentence ends; each different one is a 64-bit digest. One of over LONG
characters is cut after every word whose hash is 0 modulo CUT, and a word of over LONG characters after every character
whose hash with the one before is. A text of under SHORT characters, which has few paragraphs, has a smaller LONG and
CUT: cutting all texts as finely would quadruple the digests and with them the cost. All cuts depend on the text around
them alone, so that an insertion moves none.
A sketch has 3 regions of CELLS / 3 cells; a digest goes to one cell of each region, where a count, the exclusive-or of
the digests and that of their checks are kept. The fingerprint is the number of digests and one such sketch.

To compare two versions, the cells of one are subtracted from the other's, which cancels what both share. A cell
with one digest left (count 1 or -1, and the check fits) gives that digest away; it is taken out of its other cells,
which frees more, round by round, until nothing is left. If that fails, both versions are sketched again, larger:
the digests are dealt out to sketches of about LOAD digests each. Where one of these fails, its own digests are dealt
out again to twice as many sketches, with other hashes. After ATTEMPTS such failures its digests are compared
themselves. The likeness is (shared digests) / (all digests of both).

Everything is built-in column functions in one row; no row grows other than with its own text.

The next document is found without a global order: documents are dealt to slices of ids at approximate quantiles, and
each slice also gets the first document of the next. Texts are shuffled once.

Defined results: NULL is the empty text, which has no paragraph, as blank lines have none; two texts without any have
likeness 1. Rows with one id follow each other in the order of their texts. A NULL id comes first. A single document is its own next. An empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from roadpulse.llm.common import documents, stored

REGION = 8
CELLS = 3 * REGION
#: Digests that a sketch is expected to recover.
LOAD = 10
ATTEMPTS = 3
#: Slices for each shuffle partition; that many ids at most reach the driver.
SLICES = 4
#: A paragraph ends at a line break, or after a sentence end that white space follows.
PARAGRAPH_END = r"\n|(?<=[.!?])[ \t]+|(?<=[。！？])"
#: The same for texts without any of ``WIDE_ENDS``, tried at white space only.
NARROW_END, WIDE_ENDS = r"\n|[ \t](?<=[.!?][ \t])[ \t]*", "。！？"
LONG, CUT = 240, 16
SHORT, SHORT_LONG, SHORT_CUT = 480, 80, 2


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _if(condition: Column, then: Column, other: Column) -> Column:
    """As ``when``, which looks its branches up in a list each time it runs."""
    return F.call_function("if", condition, then, other)


def _cut(parts: Column, hashed, cut: int, glue: str) -> Column:
    """``parts`` as one text with a line break after those whose ``hashed(part, place)`` is 0 modulo ``cut``."""
    ended = lambda x, i: F.concat(x, F.when(F.pmod(hashed(x, i), F.lit(cut)) == 0, "\n").otherwise(glue))
    return F.array_join(F.transform(parts, ended), "")


def _cut_word(word: Column, cut: int) -> Column:
    return _let(F.split(word, ""), lambda chars: _cut(chars, lambda c, i: F.xxhash64(F.get(chars, i - 1), c), cut, ""))


def _cut_sentence(sentence: Column, long: int, cut: int) -> Column:
    words = F.transform(F.split(sentence, r"[ \t]+"), lambda w: F.when(F.length(w) > long, _cut_word(w, cut)).otherwise(w))
    return _cut(words, lambda w, i: F.xxhash64(w), cut, " ")


def _of_paragraphs(text: Column, made) -> Column:
    """``made(paragraph)`` of each paragraph, NULL for blank ones; strings are not copied on the way."""
    wide = reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in WIDE_ENDS])
    whole = F.when(wide, F.split(text, PARAGRAPH_END)).otherwise(F.split(text, NARROW_END))
    some = lambda p: _if(p != "", made(p), F.lit(None))
    # Cut or not, a paragraph loses one blank at its end.
    bare = lambda p: _if(F.endswith(p, F.lit(" ")), F.left(p, F.length(p) - 1), p)
    pieces = lambda p, long, cut: F.split(F.concat(_cut_sentence(p, long, cut), F.lit("\n")), " ?\n")
    parts = lambda long, cut: F.transform(whole, lambda p: _if(
        (F.octet_length(p) > long) & (F.length(p) > long), F.transform(pieces(p, long, cut), some), F.array(some(bare(p)))
    ))
    return F.array_compact(F.flatten(_if(F.length(text) < SHORT, parts(SHORT_LONG, SHORT_CUT), parts(LONG, CUT))))


def paragraphs(text: Column) -> Column:
    return _of_paragraphs(text, lambda p: p)


def digests(text: Column) -> Column:
    """Different digests of a text's paragraphs."""
    return F.array_distinct(_of_paragraphs(text, F.xxhash64))


def _check(digest: Column) -> Column:
    return F.xxhash64(digest, F.lit(99))


def _place(digest: Column, region: int, seed: Column) -> Column:
    return F.lit(region * REGION) + F.pmod(F.xxhash64(digest, F.lit(region), seed), F.lit(REGION)).cast("int")


def _places(digest: Column, seed: Column) -> Column:
    """A digest's three cells as bits."""
    bit = lambda r: F.call_function("shiftleft", F.lit(1), _place(digest, r, seed))
    return bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))


def _entry(hand: Column, sign: Column, digest: Column, check: Column, places: Column) -> Column:
    """A digest with the hand it is in, its sign and check, and the bits of its three cells; a cell has the same fields."""
    return F.struct(hand.alias("p"), sign.alias("n"), digest.alias("x"), check.alias("c"), places.alias("at"))


def _merged(cell: Column, entry: Column, sign: int) -> Column:
    """A cell with an entry put in (``sign`` 1) or taken out (-1)."""
    n = cell["n"] + entry["n"] if sign > 0 else cell["n"] - entry["n"]
    return _entry(entry["p"], n, *[cell[f].bitwiseXOR(entry[f]) for f in ("x", "c", "at")])


def _owned(entries: Column) -> Column:
    """For each cell of a sketch the entries it has."""
    bits = F.array(*[F.lit(1 << i) for i in range(CELLS)])
    return F.transform(bits, lambda bit: F.filter(entries, lambda e: e["at"].bitwiseAND(bit) != 0))


def _cells(entries: Column) -> Column:
    """A cell with a single entry is that entry."""
    none = [F.lit(0).cast(kind) for kind in ("int", "int", "long", "long", "int")]
    more = lambda own: F.aggregate(own, _entry(*none), lambda s, e: _merged(s, e, 1))
    return F.transform(_owned(entries), lambda own: _if(F.size(own) == 1, F.get(own, F.lit(0)), more(own)))


def sketch(digest_array: Column, seed: Column) -> Column:
    """CELLS structs (n, x, c)."""
    entries = F.transform(digest_array, lambda d: _entry(F.lit(0), F.lit(1), d, _check(d), _places(d, seed)))
    return F.transform(_let(entries, _cells), lambda c: F.struct(c["n"], c["x"], c["c"]))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct(
        (x["n"] - y["n"]).alias("n"), x["x"].bitwiseXOR(y["x"]).alias("x"), x["c"].bitwiseXOR(y["c"]).alias("c")
    ))


#: Rounds of peeling; one in which no cell is pure is the last.
ROUNDS = 10


def peel(cells: Column, entry=None) -> Column:
    """Struct (done, plus, minus): whether nothing is left, and how many digests only the first or only the second has.

    ``entry`` makes a pure cell the entry it has, if it isn't already. Spark copies the state in full in every round, also
    in those that are left when nothing more is to do, so that the last round leaves no cells in it.
    """

    def step(state: Column, turn: Column) -> Column:
        pure = F.filter(state["cells"], lambda c: (F.abs(c["n"]) == 1) & (c["c"] == _check(c["x"])))
        # A digest that is alone in several of its cells is taken once.
        taken = F.array_distinct(F.transform(pure, entry) if entry else pure)

        def without(found: Column) -> Column:
            plus = F.size(F.filter(found, lambda e: e["n"] == 1))
            last = F.struct(
                F.slice(state["cells"], 1, 0).alias("cells"), state["plus"], state["minus"], F.lit(True).alias("over"),
                (~F.exists(state["cells"], lambda c: (c["n"] != 0) | (c["x"] != 0) | (c["c"] != 0))).alias("done"),
            )
            more = lambda c, own: F.aggregate(own, c, lambda s, e: _merged(s, e, -1))
            left = F.zip_with(state["cells"], _owned(found), lambda c, own: _if(F.size(own) == 0, c, _if(
                F.size(own) == 1, _merged(c, F.get(own, F.lit(0)), -1), more(c, own)
            )))
            further = F.struct(
                left.alias("cells"), (state["plus"] + plus).alias("plus"), (state["minus"] + F.size(found) - plus).alias("minus"),
                F.lit(False).alias("over"), F.lit(False).alias("done"),
            )
            return _if(F.size(found) == 0, last, further)

        return _if(state["over"], state, _let(taken, without))

    start = {"cells": cells, "plus": F.lit(0), "minus": F.lit(0), "over": F.lit(False), "done": F.lit(False)}
    peeled = F.aggregate(F.array(*map(F.lit, range(ROUNDS))), F.struct(*[x.alias(n) for n, x in start.items()]), step)
    return _let(peeled, lambda p: F.struct(p["done"], p["plus"], p["minus"]))


def _difference(entries: Column) -> Column:
    """The difference from one sketch of each side's entries; they are subtracted while they are added up."""
    return peel(_cells(entries))


def _dealt(a: Column, b: Column, parts: Column, seed: Column) -> Column:
    """The difference from ``parts`` sketches, each of the digests with one remainder."""
    entry = lambda d, n: _entry(F.pmod(F.xxhash64(d, seed), parts).cast("int"), F.lit(n), d, _check(d), _places(d, seed))
    entries = F.concat(F.transform(a, lambda d: entry(d, 1)), F.transform(b, lambda d: entry(d, -1)))
    own = lambda every, p: F.filter(every, lambda e: e["p"] == p)
    hand = lambda every, p: _let(own(every, p), _difference)
    each = _let(entries, lambda every: F.transform(F.sequence(F.lit(0), parts - 1), lambda p: hand(every, p)))
    return _let(each, _added)


def _added(outcomes: Column) -> Column:
    return F.struct(
        F.forall(outcomes, lambda o: o["done"]).alias("done"),
        F.aggregate(outcomes, F.lit(0), lambda s, o: s + o["plus"]).alias("plus"),
        F.aggregate(outcomes, F.lit(0), lambda s, o: s + o["minus"]).alias("minus"),
    )


def hands(a: Column, b: Column) -> Column:
    """The digests of both as entries of sketches, about LOAD with one remainder; remainders without any are left out.

    They are hashed and sorted once, and cut where the remainder changes.
    """
    parts = F.greatest(F.lit(1), F.ceil((F.size(a) + F.size(b)) / F.lit(float(LOAD))).cast("int"))
    mark = lambda d, n: _entry(F.pmod(F.xxhash64(d, F.lit(1)), parts).cast("int"), F.lit(n), d, _check(d), _places(d, F.lit(1)))
    marks = F.sort_array(F.concat(F.transform(a, lambda d: mark(d, 1)), F.transform(b, lambda d: mark(d, -1))))

    def cut(every: Column) -> Column:
        first = lambda m, i: F.when((i == 0) | (F.get(every, i - 1)["p"] != m["p"]), i)
        starts = F.array_append(F.array_compact(F.transform(every, first)), F.size(every))
        return _let(starts, lambda at: F.transform(
            F.slice(at, F.lit(1), F.size(at) - 1), lambda s, k: F.slice(every, s + 1, F.get(at, k + 1) - s)
        ))

    return _let(marks, cut)


def _solved(hand: Column) -> Column:
    """The difference of a few entries: from one sketch, from more of them, or by comparing the digests."""
    own = lambda n: F.transform(F.filter(hand, lambda e: e["n"] == n), lambda e: e["x"])
    only = lambda n: F.size(F.array_except(own(n), own(-n)))
    exact = F.struct(F.lit(True).alias("done"), only(1).alias("plus"), only(-1).alias("minus"))

    def retry(state: Column, attempt: Column) -> Column:
        larger = _dealt(own(1), own(-1), F.pow(F.lit(2), attempt - 1).cast("int"), attempt)
        return _if(state["done"], state, _if(attempt > ATTEMPTS, exact, larger))

    return F.aggregate(F.array(*map(F.lit, range(2, ATTEMPTS + 2))), _difference(hand), retry)


def first_outcome(sketch_a: Column, sketch_b: Column) -> Column:
    cells = F.transform(subtract(sketch_a, sketch_b), lambda c: _entry(F.lit(0), c["n"], c["x"], c["c"], F.lit(0)))
    return peel(cells, lambda c: _entry(c["p"], c["n"], c["x"], c["c"], _places(c["x"], F.lit(0))))


def likeness(a: Column, first: Column, dealt: Column) -> Column:
    """Shared digests over all digests, from the fingerprints' sketches first, then from the ``hands``."""
    larger = _let(F.transform(dealt, _solved), _added)
    every = lambda o: F.size(a) + o["minus"]
    return _let(F.when(first["done"], first).otherwise(larger), lambda o: F.when(every(o) == 0, 1.0).otherwise(
        (F.size(a) - o["plus"]).cast("double") / every(o)
    ))


def encoded(digest_array: Column, cells: Column) -> Column:
    """The fingerprint as text: the number of digests, then count, digests and checks of each cell in hex."""
    cell = lambda c: F.concat_ws(".", c["n"].cast("string"), F.hex(c["x"]), F.hex(c["c"]))
    return F.concat_ws("|", F.size(digest_array).cast("string"), F.transform(cells, cell))


def fingerprint(text: Column) -> Column:
    return _let(digests(F.coalesce(text, F.lit(""))), lambda d: encoded(d, sketch(d, F.lit(0))))


def with_next(docs: DataFrame, **columns: Column) -> DataFrame:
    """(doc_id, text, next) for every row: the next in order of the id, after the last the first.

    ``columns`` are worked out once for each row, before the shuffle, and are in the row and in ``next``, as the text is.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    n = max(2, SLICES * int(spark.conf.get("spark.sql.shuffle.partitions")))
    cuts = ids.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 100 * n)).first()[0] or []
    cuts = sorted(set(cuts))
    # Binary search for the number of cuts at or below the id; a NULL id is in slice 0.
    table, steps = _constants(cuts, "bigint"), [1 << k for k in range(len(cuts).bit_length() - 1, -1, -1)]
    found = F.lit(0)
    if cuts:
        search = lambda low, step: F.when(
            (low + step <= len(cuts)) & (F.get(table, low + step - 1) <= F.col("doc_id")), low + step
        ).otherwise(low)
        found = F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), search)
    placed = docs.withColumn("slice", found)
    firsts = placed.groupBy("slice").agg(F.min("doc_id").alias("first"), F.count_if(F.col("doc_id").isNull()).alias("nulls"))
    firsts = sorted(firsts.collect(), key=lambda row: row["slice"])  # one row per slice, a bounded number
    # The first row of a slice also goes to the slice before it; that of the first slice to the last, at its end.
    by_slice = {row["slice"]: (row["first"], row["nulls"], firsts[k - 1]["slice"]) for k, row in enumerate(firsts)}
    blank, places = (None, 0, None), range(len(cuts) + 1)
    first, nulls, home = (_constants([by_slice.get(i, blank)[k] for i in places], "bigint") for k in range(3))
    of = lambda values: F.get(values, F.col("slice"))
    own = F.struct(F.col("slice").alias("slice"), F.lit(0).alias("guest"))
    guest = F.struct(of(home).cast("int").alias("slice"), F.lit(1).alias("guest"))
    is_first = F.when(of(nulls) > 0, F.col("doc_id").isNull()).otherwise(F.col("doc_id") == of(first))
    homes = F.when(F.coalesce(is_first, F.lit(False)), F.array(own, guest)).otherwise(F.array(own))
    spread = placed.withColumn("home", F.explode(homes)).select("doc_id", "text", "home.slice", "home.guest")
    for name, column in columns.items():
        spread = spread.withColumn(name, column)
    order = W.partitionBy("slice").orderBy("guest", F.col("doc_id").asc_nulls_first(), "text")
    follows = F.lead(F.struct("text", *columns)).over(order).alias("next")
    return spread.select("doc_id", "text", *columns, "guest", follows).filter("guest = 0").drop("guest")


def _constants(values: list, kind: str) -> Column:
    """An array of constants as one literal, however many they are; None is NULL. It is worked out once, not for every row."""
    text = ",".join("" if v is None else str(v) for v in values)
    return F.split(F.lit(text), ",").try_cast(f"array<{kind}>")


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints and likeness of each text, its edited version and the next document's text."""
    rows = with_next(docs, d_text=digests(F.col("text")), s_text=sketch(F.col("d_text"), F.lit(0)))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(
        F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next.text"), F.lit(1), half)
    )
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    rows = rows.withColumns({"d_edited": digests(F.col("edited")), "d_next": F.col("next.d_text"), "s_next": F.col("next.s_text")})
    rows = rows.withColumn("s_edited", sketch(F.col("d_edited"), F.lit(0)))
    others = ("edited", "next")
    rows = rows.withColumns({f"o_{c}": first_outcome(F.col("s_text"), F.col(f"s_{c}")) for c in others})
    rows = rows.withColumns({f"h_{c}": F.when(~F.col(f"o_{c}.done"), hands(F.col("d_text"), F.col(f"d_{c}"))) for c in others})
    like = lambda c: likeness(F.col("d_text"), F.col(f"o_{c}"), F.col(f"h_{c}"))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        encoded(F.col("d_text"), F.col("s_text")).alias("fingerprint"),
        encoded(F.col("d_edited"), F.col("s_edited")).alias("edited_fingerprint"),
        like("edited").alias("near_edited"), like("next").alias("near_next"),
    )


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_versions(documents(spark, sf_dir))
