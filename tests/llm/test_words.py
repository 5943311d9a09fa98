"""Words of many texts as arrays, against Python's own splitting."""

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from lexweave.llm import _words, lm


def check(texts, lower):
    column = pa.array(texts, pa.binary())
    words = _words.words_in(column, lower)
    plain = [((x or b"").lower() if lower else x or b"").split() for x in texts]
    assert np.diff(words.first).tolist() == [len(x) for x in plain]
    flat = [w for x in plain for w in x]
    own = [words.data[a:b].tobytes() for a, b in zip(words.start, words.end, strict=True)]
    assert ([w.lower() for w in own] if lower else own) == flat
    known: dict[bytes, int] = {}
    for w, h in zip(flat, words.hash.tolist(), strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.binary(max_size=30) | st.text(st.sampled_from("aAbB zZ\n\t\x0b\x1c é"), max_size=30).map(str.encode), max_size=8), st.booleans())
def test_words_are_like_split(texts, lower):
    check(texts, lower)


@pytest.mark.parametrize("size", [_words.PIECE - 1, _words.PIECE, _words.PIECE + 1, 3 * _words.PIECE])
def test_words_longer_than_a_piece(size):
    check([b"a " * 3 + b"x" * size + b" b", b"X" * size, b"y " + b"x" * (size - 1) + b" " + b"ab " * _words.PIECE], False)
    check([b"X" * size, b"x" * size], True)


def test_a_slice_of_a_column():
    column = pa.chunked_array([pa.array([b"a b", None, b"c"]), pa.array([b"d e f", b""])])
    assert np.diff(_words.words_in(column.slice(1, 3)).first).tolist() == [0, 1, 3]
    assert _words.words_in(pa.array([], pa.binary())).first.tolist() == [0]


def test_compressed_columns(spark):
    rows = [(1, b"abc " * 50), (2, None), (3, b"")]
    got = _words.squeezed(spark.createDataFrame([(i, None if b is None else bytearray(b)) for i, b in rows], "i int, raw binary")).toArrow()
    assert dict(zip(got["i"].to_pylist(), _words.unsqueezed(got["raw"]).to_pylist(), strict=True)) == dict(rows)


def test_tokens_and_pieces():
    texts = [b"One two", None, b"", b"one"] * 5
    table = pa.table({"raw": pa.array(texts, pa.binary()), "n": list(range(20))})
    tokens = lm.tokens_in(table.column("raw"))
    assert np.diff(tokens.first).tolist() == [3, 1, 1, 2] * 5 and tokens.hash[0] == tokens.hash[5] and tokens.hash[2] == lm.END
    parts = list(lm.pieces(table, 10))
    assert [n for p in parts for n in p["n"].to_pylist()] == list(range(20)) and len(parts) > 2
