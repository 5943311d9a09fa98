import pytest
import numpy as np
import pyarrow as pa
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexweave.functions.tokens import Tokenizer, TokenizerError, byte_table, is_special, parse_vocabulary, unescape

from lexweave.functions.trie import NoToken, Trie, chain, encode_column

LONGER = byte_table() | {300: b"the", 301: b"th", 302: b"then", 303: "é".encode(), 304: b" the"}


@pytest.mark.parametrize("literal,want", [
    ("'B'", b"B"), ('"it\'s"', b"it's"), (r"'\\ \' \" \n\r\t'", b"\\ ' \" \n\r\t"), (r"'\xe9'", "é".encode()), (r"b'\xe9'", b"\xe9"), (r"'你\U0001f600'", "你😀".encode()),
    ("b'\\u4f60'", None), (r"'\a'", None), (r"'\x4'", None), (r"'\ud800'", None), ("B", None), ("'", None), ("'x\"", None), ("b'é'", "é".encode()), ("''", b""), (r"'\'", None),
])
def test_unescape(literal, want):
    assert unescape(literal) == want


def test_parse_vocabulary():
    assert parse_vocabulary("67 'B' 1\n\n300 ' the x' 6\r\n67 'C' 1\n") == {67: b"C", 300: b" the x"}


@pytest.mark.parametrize("line", ["67", "67 'B'", "x 'B' 1", "67 'B' y", "0 'B' 1", "65530 'B' 1", "67 'B 1", "67 'B' 2"])
def test_parse_vocabulary_names_the_line(line):
    with pytest.raises(TokenizerError, match="^line 2: "):
        parse_vocabulary(f"66 'A' 1\n{line}")


def plain(table, data):
    """Longest prefix first, byte by byte."""
    known, out, i = {v: k for k, v in sorted(table.items()) if v}, [], 0
    while i < len(data):
        size = next(n for n in range(len(data) - i, 0, -1) if data[i : i + n] in known)
        out.append(known[data[i : i + size]])
        i += size
    return out


def ids_of(table, *texts):
    return encode_column(Trie(table), pa.array(texts, pa.binary())).to_pylist()


def test_longest_prefix():
    assert ids_of(LONGER, b"then thx", b"", None, b"th", b"e") == [[302, ord(" ") + 1, 301, ord("x") + 1], [], None, [301], [ord("e") + 1]]
    with pytest.raises(NoToken, match="no token for byte 98 at 2") as error:
        ids_of({1: b"a", 2: b"abc"}, b"aaa", b"aab")
    assert error.value.text == 1


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=6), max_size=25), st.lists(st.text("abc", max_size=40), max_size=6))
def test_like_byte_by_byte(tokens, texts):
    """Tables in which tokens end inside others, and texts side by side: no token leaves its text."""
    table = {1: b"a", 2: b"b", 3: b"c"} | {10 + i: t.encode() for i, t in enumerate(tokens)}
    assert ids_of(table, *(t.encode() for t in texts)) == [plain(table, t.encode()) for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=400))
def test_chain(steps):
    following = np.minimum(np.arange(len(steps)) + steps, len(steps))
    want, at = [], 0
    while at < len(steps):
        want.append(at)
        at = int(following[at])
    assert chain(following).tolist() == want


def test_large_table():
    """As many tokens as an id space has, and one long text."""
    rng = np.random.default_rng(1)
    table = byte_table() | {257 + i: bytes(rng.integers(97, 105, size=rng.integers(2, 12)).tolist()) for i in range(40_000)}
    text = bytes(rng.integers(97, 106, size=30_000).tolist())
    assert ids_of(table, text, text[:17]) == [plain_fast(table, text), plain(table, text[:17])]


def plain_fast(table, data):
    known, out, i = {v: k for k, v in sorted(table.items())}, [], 0
    while i < len(data):
        size = next(n for n in range(12, 0, -1) if i + n <= len(data) and data[i : i + n] in known)
        out.append(known[data[i : i + size]])
        i += size
    return out


TEXTS = ["Ďábel sní žluté jablko", "привет, мир 🦊", "…", "line one\r\nline two\x00\x7f", "", None, "then the é", "한국어 텍스트"]


@pytest.mark.parametrize("table", [None, LONGER])
def test_round_trip(spark, table):
    t = Tokenizer(spark, table)
    df = spark.createDataFrame([(x,) for x in TEXTS], "t string").withColumn("ids", t.encode(F.col("t")))
    rows = df.select("t", "ids", t.decode(F.col("ids")).alias("back"), F.exists("ids", is_special).alias("special")).collect()
    assert [r["back"] for r in rows] == TEXTS
    assert not any(r["special"] for r in rows)


@settings(max_examples=20, deadline=None)
@given(st.text(max_size=40))
def test_trie_round_trip(text):
    data = text.encode("utf-8", "surrogatepass")
    assert b"".join(LONGER[t] for t in ids_of(LONGER, data)[0]) == data


def test_decode_needs_no_python(spark):
    t = Tokenizer(spark, LONGER)
    plan = spark.range(3).select(t.decode(F.array(F.lit(301), "id")).alias("t"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


@pytest.mark.parametrize("table", [None, LONGER])
def test_decode_skips_specials_and_bears_partial_utf8(spark, table):
    t = Tokenizer(spark, table)
    df = spark.createDataFrame([([0xC4],), ([0xC4, 0xAA],), ([65531, 66, 0, 65530],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(t.decode(F.col("ids"))).collect()] == ["�", "é", "A", ""]


@pytest.mark.parametrize("table", [None, LONGER])
def test_token_bytes(spark, table):
    t = Tokenizer(spark, table)
    df = spark.createDataFrame([(66,), (65530,), (0,), (303 if table else 70,)], "id int")
    assert [None if r[0] is None else bytes(r[0]) for r in df.select(t.token_bytes(F.col("id"))).collect()] == [b"A", None, None, "é".encode() if table else b"E"]


def test_load(spark, tmp_path):
    path = tmp_path / "vocabulary.txt"
    path.write_text("66 'A' 1\n300 'AB' 2\n", encoding="utf-8")
    t = Tokenizer.load(spark, str(path))
    assert t.table == {66: b"A", 300: b"AB"} and t.frame().count() == 2
