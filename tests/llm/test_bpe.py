import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelattice.llm.bpe import Encoder, count_tokens, encode_texts, scan_states
from notelattice.llm.queries import vocabulary

P = pytest.importorskip("public_tokenizers")
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def own():
    return Encoder(vocabulary())


@pytest.fixture(scope="module")
def other():
    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def same(own, other, texts):
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    for text, a, b, e in zip(texts, ends - counts, ends, other.encode_batch(texts, add_special_tokens=False)):
        assert ids[a:b].tolist() == e.ids, repr(text)[:200]
        assert own.decode(ids[a:b].tolist()) == text


def test_agrees_on_mixed_pieces(own, other):
    r = random.Random(3)
    pool = ["'", "s", "t", "re", "r", "e", "'ll", "l", "v", "ve", "d", "m", " ", "  ", "\n", "\t", "1", "²", "é", "e\u0301", "中", "!", "..", "😀", "\u200d", "_", "\x00", "\x1c", "\u3000", "\x85", "\r\n"]
    same(own, other, ["".join(r.choice(pool) for _ in range(r.randint(0, 25))) for _ in range(3000)])


def test_agrees_on_every_plane(own, other):
    points = [c for c in range(0x1, 0x30000) if not 0xD800 <= c < 0xE000]
    import unicodedata

    known = [c for c in points if unicodedata.category(chr(c)) not in ("Cn", "Co")]
    same(own, other, [f"a{chr(c)}1 {chr(c)}{chr(c)}'s" for c in known[::7]])


def test_long_and_special(own, other):
    same(own, other, ["a" * 5000, "=" * 30_000, " " * 3000 + "x", "<|endoftext|> hi", ""])


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_round_trip(texts):
    own = Encoder(vocabulary()) if not hasattr(test_round_trip, "own") else test_round_trip.own
    test_round_trip.own = own
    ids, counts = own.encode(texts)
    ends = np.cumsum(counts)
    for text, a, b in zip(texts, ends - counts, ends):
        assert own.decode(ids[a:b].tolist()) == text


def test_scan_equals_a_loop():
    r = np.random.default_rng(1)
    step = r.integers(0, 5, (7, 5)).astype(np.uint8)
    for n in (0, 1, 2, 17, 1000):
        symbols = r.integers(0, 7, n)
        state, want = 2, []
        for s in symbols:
            want.append(state)
            state = step[s, state]
        assert scan_states(symbols, step, 2).tolist() == want


def test_dirty_rows(spark, own, long_text):
    rows = [(1, None, "x"), (2, "", "x"), (2, "again", "x"), (3, long_text, None), (None, "no key", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    out = encode_texts(df, "doc_id", "text", vocabulary(), with_offsets=True)
    assert out.columns == ["doc_id", "ids", "offsets"]
    got = out.collect()
    assert len(got) == 5
    assert [r.ids for r in got if r.doc_id == 1] == [[]]
    assert sorted(len(r.ids) for r in got if r.doc_id == 2)[0] == 0
    long = next(r for r in got if r.doc_id == 3)
    assert own.decode(long.ids) == long_text
    assert long.offsets[:2] == [0, len(own.tokens[long.ids[0]])]
    counts = {r.doc_id: r.n_tokens for r in count_tokens(df, ["doc_id"], "text", vocabulary()).filter("doc_id = 3").collect()}
    assert counts[3] == len(long.ids)
    assert encode_texts(df.limit(0), "doc_id", "text", vocabulary()).collect() == []
