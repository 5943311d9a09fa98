import unicodedata

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexweave.functions.hashing import _mix, fnv1a64, limbs_hex, limbs_mod, seeded, splitmix64, unsigned_order
from lexweave.functions.text import is_blank, node_key, normalize_key, trim_unicode, with_nfc

KEYS = [
    ("Run!", "run"), ("  Run.  ", "run"), ("I'm   fine,  thanks.", "i m fine thanks"), ("Você está bem?", "você está bem"), ("Você", "você"), ("你好！", "你好"),
    ("?!", "?!"), (" ?! ", "?!"), ("", ""), ("ΟΔΟΣ", "οδοσ"), ("İstanbul", "i stanbul"), ("½ Ⅷ _x", "½ ⅷ x"), ("　a B\t", "a b"), ("हिन्दी", "हिन दी"),
]


def keys(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r["k"] for r in with_nfc(df, "t").select("i", normalize_key(F.col("t")).alias("k")).orderBy("i").collect()]


def test_normalize_key_cases(spark):
    assert keys(spark, [t for t, _ in KEYS]) == [k for _, k in KEYS]


def plain_key(text):
    out = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())
    return " ".join(out.split()) or None


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(st.sampled_from("aBÉß.,! \t'0é ΣxYZ-_"), max_size=30), min_size=1, max_size=40))
def test_normalize_key_is_like_a_plain_version(spark, texts):
    for got, text in zip(keys(spark, texts), texts, strict=True):
        want = plain_key(text)
        assert got == (want if want is not None else unicodedata.normalize("NFC", text).strip())


def test_node_key_and_blank(spark):
    r = spark.range(1).select(
        node_key(F.lit("en"), F.lit("Hi!")).alias("k"), is_blank(F.lit(" \t ")).alias("b"), is_blank(F.lit("x")).alias("n"), trim_unicode(F.lit("　x y\t")).alias("t")
    ).first()
    assert tuple(r) == ("en\u001fhi", True, False, "x y")


@pytest.mark.parametrize("text,want", [("", "cbf29ce484222325"), ("a", "af63dc4c8601ec8c"), ("foobar", "85944171f73967e8")])
def test_fnv1a64_published_vectors(spark, text, want):
    df = spark.createDataFrame([(text,)], "t string")
    r = df.select(limbs_hex(fnv1a64(F.col("t"))).alias("h"), limbs_mod(fnv1a64(F.col("t")), 1000).alias("m")).first()
    assert r["h"] == want and r["m"] == int(want, 16) % 1000


def test_fnv1a64_is_like_a_plain_version(spark):
    texts = ["é" * 40, "x" * 500, "\u001f", "日本語 text"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(limbs_hex(fnv1a64(F.col("t")))).collect()]
    for text, h in zip(texts, got, strict=True):
        want = 0xCBF29CE484222325
        for b in text.encode():
            want = (want ^ b) * 0x100000001B3 % (1 << 64)
        assert h == f"{want:016x}"


def test_splitmix_and_unsigned_order(spark):
    rows = spark.range(50).select("id", splitmix64(F.col("id")).alias("z"), unsigned_order(seeded(F.col("id"), 42)).alias("o"), seeded(F.col("id"), 42).alias("s")).collect()

    def plain(x):
        z = (x + 0x9E3779B97F4A7C15) % (1 << 64)
        z = (z ^ (z >> 30)) * 0xBF58476D1CE4E5B9 % (1 << 64)
        z = (z ^ (z >> 27)) * 0x94D049BB133111EB % (1 << 64)
        return z ^ (z >> 31)

    assert all(r["z"] % (1 << 64) == plain(r["id"]) for r in rows)
    assert [r["id"] for r in sorted(rows, key=lambda r: r["o"])] == sorted(range(50), key=lambda i: plain(i ^ 42))
    assert len({int(x) for x in _mix(__import__("numpy").arange(1000, dtype="uint64"))}) == 1000


def test_fnv1a64_of_null_and_nothing(spark):
    df = spark.createDataFrame([("a",), (None,)], "t string")
    assert [None if r[0] is None else r[0] for r in df.select(limbs_hex(fnv1a64(F.col("t")))).collect()] == ["af63dc4c8601ec8c", None]
    assert df.limit(0).select(fnv1a64(F.col("t"))).count() == 0
