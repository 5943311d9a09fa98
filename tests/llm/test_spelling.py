"""Near words, forms and roots against a plain version over all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from lexweave.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_words(rows):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = Counter()
    for r in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            run = run.translate(lower)
            h = 1 if r[0] is None else zlib.crc32(f"{r[0]}:{run}".encode())
            at = h % len(run)
            found[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in found.items() if len(w) >= 7 and n >= 2}


def plain(words):
    form, count = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        form[w], count[w] = (best if best is not None and words[best] >= 10 * n else None), len(others)
    out = set()
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, count[w], words.get(form[w])))
    return out


def rows_of(df):
    return {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_whole_query(spark, make_docs, odd_texts):
    rng = np.random.default_rng(4)
    stems = ["überraschung", "straßenbahn", "aaaaaaaa", "aaaaaaa", "aaaaaaaaa", "abcabcabc", "Ðþÿñöüä"]
    typed = [w[:i] + c + w[j:] for w in stems for i in range(len(w) + 1) for j in (i, i + 1) for c in ("", "a", "ß", "z")]
    texts = [" ".join(rng.choice(typed, size=60)) for _ in range(40)] + [" ".join(stems) + ", " + "Überraschung/straßenbahn2aaaaaaaa " * 25] * 4
    rows = [*odd_texts, *((1000 + i, t) for i, t in enumerate(texts)), (2000, "y" * 30_000 + " " + "y" * 29_999), (2001, "y" * 30_000), (2002, "y" * 29_999)]
    words = plain_words(rows)
    found = spelling.vocabulary(make_docs(spark, rows))
    assert {(r["word"], r["n"]) for r in found.collect()} == set(words.items())
    for most in (4000, 3):
        assert rows_of(spelling.spelling_variants(found, most=most)) == plain(words)


def test_chain_of_forms(spark):
    """Each form a letter on, up to 13 steps: the root is the last of them."""
    chain = {"abcdefghijklmnopq"[: 17 - i]: 10**i for i in range(11)}
    got = rows_of(spelling.spelling_variants(spark.createDataFrame(list(chain.items()), "word string, n long")))
    assert got == plain(chain) and {r[2] for r in got} == {"abcdefg"}


def test_empty(spark, make_docs):
    out = spelling.spelling_variants(spelling.vocabulary(make_docs(spark, [])))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"] and out.count() == 0


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.text("abé", min_size=0, max_size=1).map(lambda s: s), st.text("abé", min_size=4, max_size=4)), max_size=40))
def test_trie_pairs(parts):
    """All pairs under each root, each once, whatever the words."""
    rows = sorted({(root, extra + rest) for root, extra, rest in parts})
    raw = [w.encode("latin-1") for _, w in rows]
    length = np.array([len(w) for w in raw], dtype=np.int64)
    letters = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64)
    root = np.array([r for r, _ in rows], dtype=np.int64)
    start = np.cumsum(length) - length
    i, j = spelling.near_pairs(spelling.levels_of(root, 3, letters, start, length, length > 4))
    got = sorted(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist(), strict=True))
    want = [(a, b) for a in range(len(rows)) for b in range(a + 1, len(rows)) if root[a] == root[b] and near(rows[a][1], rows[b][1]) and min(length[a], length[b]) == 4]
    assert got == sorted(want)


def test_parts_are_small(spark):
    """A vocabulary that is dense under one beginning: no part that can be halved holds more than it may, and no pair is lost."""
    words = {"abcd" + a + b + c + d: 2 for a in "abcd" for b in "abcd" for c in "abcd" for d in "abcd"} | {"abc" + a + b + c + d: 30 for a in "abd" for b in "abcd" for c in "abcd" for d in "abcd"}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    parts = spelling.parts_of(frame, most=40)
    sizes = parts.groupBy("key", "g", "low", "high").count().collect()
    assert max(r["count"] for r in sizes if min(r["high"], r["g"]) - r["low"] > 1) <= 40
    assert rows_of(spelling.spelling_variants(frame, most=40)) == plain(words)


@pytest.mark.parametrize("text", ["", "abcdefg", "é", "ÿÀx"])
def test_latin(text):
    import pyarrow as pa

    points, start, length = spelling.latin(pa.array(["zz", text, "q"])[1:])
    assert points[start[0] : start[0] + length[0]].tolist() == [ord(c) for c in text] and length.tolist() == [len(text), 1]
