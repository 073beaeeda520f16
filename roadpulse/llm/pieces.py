"""Exact SentencePiece encoding (merge type, byte fallback) by backtracking, and decoding.

A sequence of pieces is what repeated merging would give if every piece merges to itself and no two neighbours would
merge otherwise. So a text is encoded from left to right with the longest piece that an Aho-Corasick automaton finds
at each place; a piece must be compatible with the one before it, which re-merging the two decides, else its next
shorter prefix is tried, else the piece before is given up and a bitfield remembers that its end leads nowhere.

Re-merging two pieces needs no queue: each piece alone has a fixed order of merges, which is worked out once. The two
orders are run side by side, the better-scored head first; the pieces are incompatible if at any moment the parts that
face each other across the border form a piece that comes before both heads.

Texts are cut where no piece can reach across: before a space, and around line breaks if no piece holds one. Each
part is encoded once per task and kept in a table of KEPT_BYTES at most, which is let go when the task ends. Runs of spaces, whose pieces tie in score, are
merged directly. The vocabulary is read on the driver from ``model``, a parameter, and sent to the tasks.

Defined results: NULL is encoded as the empty text, to no ids, and decodes to the empty text. The library treats the
character U+2581 as a space; so does this. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadpulse.llm.common import documents

SPACE = "▁"
_NEVER = float("-inf")
#: Bytes that the parts kept by a task take at most, and what one takes beside its characters.
KEPT_BYTES, PART_BYTES = 96 << 20, 200
#: Pairs of pieces whose compatibility a task keeps at most.
KEPT_PAIRS = 200_000


def merge(symbols: list[str], scores: dict[str, float]) -> list[str]:
    """Merge the best-scored pair, the leftmost of equals, until none is a piece."""
    parts: list[str | None] = list(symbols)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    pair = lambda i, j: (-scores[p], i, j, p) if (p := parts[i] + parts[j]) in scores else None
    heap = [x for i in range(len(parts) - 1) if (x := pair(i, i + 1))]
    heapify(heap)
    while heap:
        _, i, j, joined = heappop(heap)
        if parts[i] is None or after[i] != j or j >= len(parts) or parts[j] is None or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < len(parts):
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < len(parts) and (found := pair(x, y)):
                heappush(heap, found)
    return [p for p in parts if p is not None]


def merges(piece: str, scores: dict[str, float]) -> list[tuple[float, str, str]]:
    """The merges that build ``piece`` from its characters, in their order: score, and the first and last part after it."""
    parts, out = list(piece), []
    while True:
        best = None
        for i in range(len(parts) - 1):
            score = scores.get(parts[i] + parts[i + 1])
            if score is not None and (best is None or score > best[0]):
                best = score, i
        if best is None:
            return out
        score, i = best
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out.append((score, parts[0], parts[-1]))


@dataclass(frozen=True)
class Vocabulary:
    """Pieces that merging can produce, with their ids and scores, and the ids of the 256 bytes."""

    ids: dict[str, int]
    scores: dict[str, float]
    whole: frozenset[str]
    byte_ids: tuple[int, ...]
    texts: dict[int, str] = field(default_factory=dict)


def load_vocabulary(model: str) -> Vocabulary:
    from sentencepiece import SentencePieceProcessor

    library = SentencePieceProcessor(model_file=model)
    ids, scores, byte_ids = {}, {}, {}
    for i in range(library.get_piece_size()):
        piece = library.id_to_piece(i)
        if library.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (library.is_control(i) or library.is_unknown(i) or library.is_unused(i)):
            ids[piece], scores[piece] = i, library.get_score(i)
    if len(byte_ids) != 256:
        raise ValueError("the model has no byte fallback")
    whole = frozenset(p for p in ids if merge(list(p), scores) == [p])
    return Vocabulary(ids, scores, whole, tuple(byte_ids[b] for b in range(256)), {i: p for p, i in ids.items()})


class _Orders(dict):
    """Piece -> its merges. Pieces of the vocabulary and single characters, each worked out once."""

    def __init__(self, scores: dict[str, float]) -> None:
        super().__init__()
        self.scores = scores

    def __missing__(self, piece: str) -> list[tuple[float, str, str]]:
        found = merges(piece, self.scores)
        if piece in self.scores:
            self[piece] = found
        return found


class Encoder:
    """Encodes and decodes in one task."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        import ahocorasick

        self.v = vocabulary
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for piece in vocabulary.whole:
            self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.cut_lines = not any("\n" in piece for piece in vocabulary.ids)
        self.orders = _Orders(vocabulary.scores)
        self.known: dict[tuple[str, str], bool] = {}
        self.bytes_of = {i: b for b, i in enumerate(vocabulary.byte_ids)}

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging the characters of both gives these two pieces again."""
        scores = self.v.scores
        lefts, rights = self.orders[left], self.orders[right]
        a, b, i, j = left[-1], right[0], 0, 0
        across = scores.get(a + b, _NEVER)
        while i < len(lefts) or j < len(rights):
            x = lefts[i][0] if i < len(lefts) else _NEVER
            y = rights[j][0] if j < len(rights) else _NEVER
            if across > x and across >= y:  # of equal scores, the leftmost pair is merged first
                return False
            if x >= y:
                edge, i = lefts[i][2], i + 1
                if edge == a:
                    continue
                a = edge
            else:
                edge, j = rights[j][1], j + 1
                if edge == b:
                    continue
                b = edge
            across = scores.get(a + b, _NEVER)
        return across == _NEVER

    def pieces(self, text: str) -> list[str]:
        """The pieces of a text without runs of spaces; a character outside the vocabulary is a piece of its own."""
        n, whole, known = len(text), self.v.whole, self.known
        if text in whole:
            return [text]
        longest = [1] * n
        for end, length in self.automaton.iter(text):
            longest[end - length + 1] = length
        failed, at, out, last = 0, 0, [], ""
        while at < n:
            length = longest[at]
            while True:
                end = at + length
                piece = text[at:end]
                if not (failed and failed >> end & 1):
                    fits = not last or known.get((last, piece))
                    if fits or fits is None and self._judge(last, piece):
                        out.append(piece)
                        last, at = piece, end
                        break
                length -= 1
                while length > 1 and text[at : at + length] not in whole:
                    length -= 1
                if length < 1:
                    failed |= 1 << at
                    length = len(out.pop())
                    last = out[-1] if out else ""
                    at -= length
        return out

    def _judge(self, last: str, piece: str) -> bool:
        """``compatible``, kept for the pairs of KEPT_PAIRS at most."""
        fits = self.compatible(last, piece)
        if last in self.v.scores and piece in self.v.scores:
            if len(self.known) >= KEPT_PAIRS:
                self.known.clear()
            self.known[last, piece] = fits
        return fits

    def to_ids(self, pieces: list[str]) -> list[int]:
        ids: list[int] = list(map(self.v.ids.get, pieces))
        if None not in ids:
            return ids
        ids = []
        for piece in pieces:
            known = self.v.ids.get(piece)
            if known is None:
                ids += [self.v.byte_ids[b] for b in piece.encode()]
            else:
                ids.append(known)
        return ids

    def run_pieces(self, spaces: int) -> list[str]:
        return merge([SPACE] * spaces, self.v.scores)

    def parts(self, text: str) -> list[str]:
        """Parts that no piece reaches across; an empty part is one more space before the next part."""
        text = text.replace(SPACE, " ")
        return (text.replace("\n", " \n") if self.cut_lines else text).split(" ")

    def part_ids(self, part: str, spaces: int = 0) -> list[int]:
        """The ids of a part with so many more spaces before it."""
        if self.cut_lines and part.startswith("\n"):
            return self.to_ids(self.run_pieces(spaces) + self.pieces(part))
        pieces = self.pieces(SPACE + part)
        if not spaces:
            return self.to_ids(pieces)
        if pieces[0] == SPACE:
            return self.to_ids(self.run_pieces(spaces + 1) + pieces[1:])
        return self.to_ids(self.run_pieces(spaces) + pieces)

    def runs(self, parts: list[str]) -> Iterator[tuple[str | None, int]]:
        """(part, spaces before it), and (None, spaces) at the end."""
        spaces = 0
        for part in parts:
            if part:
                yield part, spaces
                spaces = 0
            else:
                spaces += 1
        if spaces:
            yield None, spaces

    def encode(self, text: str | None) -> list[int]:
        ids: list[int] = []
        for part, spaces in self.runs(self.parts(text)) if text else ():
            ids += self.to_ids(self.run_pieces(spaces)) if part is None else self.part_ids(part, spaces)
        return ids

    def spell(self, ids: list[int]) -> str:
        """The text of ids, with the space that stands before every text."""
        known = list(map(self.v.texts.get, ids))
        if None not in known:
            return "".join(known).replace(SPACE, " ")
        out, pending = [], bytearray()
        for i in ids:
            if (byte := self.bytes_of.get(i)) is not None:
                pending.append(byte)
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.v.texts.get(i, ""))
        out.append(pending.decode("utf-8", "replace"))
        return "".join(out).replace(SPACE, " ")

    def decode(self, ids: list[int] | None) -> str:
        return self.spell(ids).removeprefix(" ") if ids else ""


class _Kept(dict):
    """Part -> its ids as text, worked out once while there is room.

    Ids are spelled when they are worked out. A part that its ids don't spell is never kept and sets ``odd``. When half the
    room is full, what was not used since the last time makes way.
    """

    def __init__(self, encoder: Encoder) -> None:
        super().__init__()
        self.encoder, self.bytes, self.older, self.odd = encoder, 0, {}, False

    def __missing__(self, part: str) -> str:
        ids = self.older.get(part)
        if ids is None:
            numbers = self.encoder.part_ids(part)
            ids = ",".join(map(str, numbers))
            lone = self.encoder.cut_lines and part.startswith("\n")
            if self.encoder.spell(numbers) != (part if lone else " " + part):
                self.odd = True
                return ids
        self.bytes += PART_BYTES + 2 * len(part) + len(ids)
        if self.bytes > KEPT_BYTES // 2:
            self.older = dict(self)
            self.clear()
            self.bytes = 0
        self[part] = ids
        return ids


def _texts(column: pa.Array) -> list[str]:
    return column.cast(pa.large_string()).fill_null("").to_pylist()


def encode(docs: DataFrame, model: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    docs = docs.drop(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found = [encoder.encode(x) for x in _texts(batch.column(batch.schema.get_field_index(text)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.list_(pa.int32()))], [*batch.schema.names, ids])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """``rows`` with the text of each array of ids."""
    shared = rows.sparkSession.sparkContext.broadcast(load_vocabulary(model))
    rows = rows.drop(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for batch in batches:
            found = [encoder.decode(x) for x in batch.column(batch.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, text])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(text, T.StringType())]))


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the ids of each text and what they decode to, as digests."""
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        kept = _Kept(encoder)
        digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
        for batch in batches:
            counts, ids_digests, text_digests = [], [], []
            for text in _texts(batch.column(1)):
                parts, kept.odd = encoder.parts(text), False
                ids = None if "" in parts else ",".join(map(kept.__getitem__, parts))
                if ids is None or kept.odd:
                    found = encoder.encode(text)
                    ids, decoded = ",".join(map(str, found)), encoder.decode(found)
                else:
                    decoded = text.replace(SPACE, " ")  # every part spells itself
                counts.append(ids.count(",") + 1 if ids else 0)
                ids_digests.append(digest(ids))
                text_digests.append(digest(decoded))
            columns = [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select("doc_id", F.col("text").cast("string"))
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    return rows.mapInArrow(run, T.StructType([docs.schema["doc_id"], *fields]))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op4_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), default_model())
