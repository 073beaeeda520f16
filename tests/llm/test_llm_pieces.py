import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from roadpulse.llm import pieces
from roadpulse.llm.pieces import Encoder, Vocabulary, decode, default_model, encode, load_vocabulary, merge, round_trip

sentencepiece = pytest.importorskip("sentencepiece")
MODEL = default_model()
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
ENCODER = Encoder(load_vocabulary(MODEL))
PARTS = ["a", "b", "e", "th", " ", "  ", "\n", "\t", "é", "1", "▁", "日本", "😀", "<s>", "<0x41>", "ing", "   ", "\r", "．", "\x00", "aaaa"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=14).map("".join) | st.text(max_size=30))
def test_equals_the_library(text):
    ids = ENCODER.encode(text)
    assert ids == LIBRARY.encode(text)
    assert ENCODER.decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("text", ["", "x" * 4000, " " * 3000, "ab" * 2000, "\n" * 60, "é" * 900, "▁▁ a"])
def test_long_and_odd_texts(text):
    assert ENCODER.encode(text) == LIBRARY.encode(text)


def test_backtracking_gives_up_pieces():
    """The longest first piece is not what merging would give, and a piece before has to be given up for that."""
    scores = {c: -9.0 for c in "abcd"} | {"ab": -2.0, "bc": -1.0, "cd": -3.0}
    ids = {p: n for n, p in enumerate(scores)}
    encoder = Encoder(Vocabulary(ids, scores, frozenset(ids), tuple(range(100, 356))))
    assert merge(list("abcd"), scores) == encoder.pieces("abcd") == ["a", "bc", "d"]
    assert merge(list("abab"), scores) == encoder.pieces("abab") == ["ab", "ab"]


def test_round_trip_and_interfaces(spark, documents):
    rows = [(1, "Hello  world\nagain"), (2, None), (3, ""), (4, "the the the"), (4, "the the the"), (None, "x" * 50_000)]
    docs = documents(rows)
    key = lambda r: tuple(map(str, r))
    want = []
    for i, text in rows:
        ids = LIBRARY.encode(text or "")
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want.append((i, len(ids), digest(",".join(map(str, ids))), digest(LIBRARY.decode(ids) if ids else "")))
    assert sorted(map(tuple, round_trip(docs, MODEL).collect()), key=key) == sorted(want, key=key)
    ids = encode(docs.withColumnRenamed("lang", "ids"), MODEL)
    for r in decode(ids, MODEL).collect():
        assert r["ids"] == LIBRARY.encode(r["text"] or "") and r["decoded"] == (r["text"] or "")
    assert round_trip(documents([]), MODEL).count() == 0


def test_merge_orders_decide_like_merging_again():
    """Side by side, the two orders of merges say what merging all characters says, for scores in any order and with ties."""
    rng = random.Random(11)
    for _ in range(300):
        scores = {"".join(rng.choices("abc", k=rng.randint(2, 5))): float(-rng.randint(0, 12)) for _ in range(25)}
        whole = [p for p in scores if pieces.merge(list(p), scores) == [p]] + list("abcd")
        encoder = pieces.Encoder(pieces.Vocabulary({p: i for i, p in enumerate(scores)}, scores, frozenset(whole), tuple(range(256))))
        for left in whole:
            for right in whole:
                assert encoder.compatible(left, right) == (pieces.merge([*left, *right], scores) == [left, right])


def test_kept_parts_stay_within_their_room(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_BYTES", 20_000)
    encoder = pieces.Encoder(pieces.load_vocabulary(pieces.default_model()))
    kept = pieces._Kept(encoder)
    words = [f"word{i % 90}x{i % 7}" for i in range(3000)]
    assert [kept[w] for w in words] == [",".join(map(str, encoder.part_ids(w))) for w in words]
    assert len(kept) + len(kept.older) < 120
