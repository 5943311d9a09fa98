"""Operators that find copies, against plain versions."""

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from lexweave.llm import decontaminate, embeddings, simhash, substring
from lexweave.llm._common import HashSet, covered, sliding_min, unite, window_hashes

u64 = lambda x: np.array(x, dtype=np.uint64)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=40), st.integers(1, 14))
def test_window_helpers(values, n):
    x = u64(values) + np.uint64(1)
    h = window_hashes(x, n)
    windows = [tuple(values[i : i + n]) for i in range(len(values) - n + 1)]
    assert len(h) == len(windows) and len(set(h.tolist())) == len(set(windows))
    if len(values) >= n:
        assert sliding_min(x, n).tolist() == [min(w) + 1 for w in windows]
    table = np.unique(x[::2])
    assert HashSet(table).has(x).tolist() == [v in set(table.tolist()) for v in x.tolist()]


def test_covered_and_unite():
    assert covered(np.array([1, 2]), 3, 6).tolist() == [False, True, True, True, True, False]
    parent = np.arange(6)
    unite(parent, np.array([5, 3, 1]), np.array([3, 1, 4]))
    assert parent.tolist() == [0, 1, 2, 1, 1, 1]


def components(n, linked, names):
    """Smallest name reachable; ``linked`` a boolean matrix."""
    label = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in np.flatnonzero(linked[i]):
                if label[j] != label[i]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = []
    for i in range(n):
        own = [names[j] for j in range(n) if label[j] == label[i] and names[j] is not None]
        out.append(min(own) if own else None)
    return out


# --- embeddings


def vectors(seed=1, n=60, d=16):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(20, 40):
        x[i] = x[i - 20] + rng.normal(size=d) * rng.choice([0.05, 0.3, 0.45, 0.5, 0.55])
    x[45], x[46], x[47] = x[44], x[44], 3 * x[44]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(200, None), (201, []), (202, [0.0] * d), (203, [float("nan")] + [1.0] * (d - 1)), (204, [float("inf")] + [1.0] * (d - 1)), (205, [None] + [1.0] * (d - 1))]
    rows += [(206, x[0][:8].tolist()), (207, x[1][:8].tolist()), (208, x[1][:8].tolist()), (None, x[44].tolist()), (44, x[2].tolist()), (-7, [1e-160] * d), (-6, [1e160] * d)]
    return rows


@pytest.mark.parametrize("tile", [8192, 7, 2])
def test_embedding_groups(spark, tile):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rep int, vec int")
    got = embeddings.embedding_groups(df, 0.9, tile).collect()
    ok = [v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for _, v in rows]
    linked = np.zeros((len(rows), len(rows)), dtype=bool)
    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows):
            if i != j and ok[i] and ok[j] and len(a) == len(b):
                p, q = np.array(a) / np.max(np.abs(a)), np.array(b) / np.max(np.abs(b))
                linked[i, j] = p @ q / np.linalg.norm(p) / np.linalg.norm(q) >= 0.9
    comp = components(len(rows), linked, [i for i, _ in rows])
    comp = [c if o else i for c, o, (i, _) in zip(comp, ok, rows, strict=True)]
    want = sorted(((i, int(n), c, i is not None and i == c) for (i, _), n, c in zip(rows, linked.sum(axis=1), comp, strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_smallest_numbers(spark):
    """Vectors of the least numbers that there are point where they point."""
    rows = [(1, [5e-324, 5e-324]), (2, [1.0, 0.0]), (3, [1.0, 1.0]), (4, [1e-320, 3e-320]), (5, [1.0, 3.0])]
    got = {r["vec_id"]: r["component_id"] for r in embeddings.embedding_groups(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 0.99).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4}


def test_int8_bounds_hold():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 64)) * rng.choice([1e-3, 1, 1e3], size=(300, 1))
    x[:50, 0] *= 50
    unit, q, scale, error = embeddings.quantise(x)
    true = unit @ unit.T
    near = (q.astype(np.int64) @ q.astype(np.int64).T) * scale[:, None] * scale[None, :]
    assert (np.abs(true - near) <= error[:, None] * (1 + error[None, :]) + error[None, :] + 1e-12).all()


@pytest.mark.parametrize("d", [1024, 1025, 8192])
def test_products_are_exact_for_long_vectors(d):
    rng = np.random.default_rng(d)
    q = np.sign(rng.normal(size=(20, d))).astype(np.int8) * np.int8(127)
    q[10:] = rng.integers(-127, 128, size=(10, d))
    assert np.array_equal(embeddings.exact_products(q, q.astype(np.float32).T), (q.astype(np.int64) @ q.astype(np.int64).T).astype(float))


def test_no_vectors(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert embeddings.embedding_groups(df).count() == 0


# --- simhash


def plain_fingerprint(text, k=3):
    words = [w for w in text.encode().lower().split()] if text else []
    grams = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    votes = [sum(xxhash.xxh64_intdigest(g, 42) >> b & 1 for g in grams) for b in range(64)]
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def test_simhash_groups(spark, make_docs, odd_texts):
    got = simhash.simhash_groups(make_docs(spark, odd_texts)).collect()
    fp = [plain_fingerprint(t) for _, t in odd_texts]
    linked = np.array([[bin(a ^ b).count("1") <= 3 for b in fp] for a in fp])
    comp = components(len(fp), linked, [i for i, _ in odd_texts])
    want = sorted(((i, f - (1 << 64) if f >> 63 else f, c) for (i, _), f, c in zip(odd_texts, fp, comp, strict=True)), key=str)
    assert sorted((tuple(r) for r in got), key=str) == want


def test_rows_without_an_id_link_others(spark, monkeypatch):
    """A chain of fingerprints two bits apart: those in the middle have only rows without an id."""
    chain = [0, 0b11, 0b1111, 0b111111, 0b11111111]
    prints = [(7, chain[0]), (None, chain[1]), (None, chain[1]), (None, chain[2]), (None, chain[3]), (-3, chain[4]), (5, 0x0F0F0F0F0F0F0000), (None, 0x3333333300000000), (None, -1)]
    monkeypatch.setattr(simhash, "fingerprints", lambda docs, shingle: spark.createDataFrame(prints, "doc_id long, fp long"))
    got = sorted(map(tuple, simhash.simhash_groups(spark.createDataFrame([], "doc_id long, text string")).collect()), key=str)
    assert got == sorted(((i, f, -3 if f in chain else i) for i, f in prints), key=str)


@pytest.mark.parametrize("chunk", [8192, 5])
@pytest.mark.parametrize("bits", [3, 2, 0])
def test_simhash_links(spark, chunk, bits):
    """Near, far and many fingerprints in crowded cells."""
    rng = np.random.default_rng(4)
    base = [int(x) for x in rng.integers(0, 1 << 63, size=40)]
    fps = set(base)
    for b in base[:15]:
        for n in (1, 2, 3, 4, 6):
            fps.add(b ^ sum(1 << int(i) for i in rng.choice(64, size=n, replace=False)))
    fps |= {base[0] ^ (1 << i) ^ (1 << j) for i in range(14) for j in range(i)}
    fps = sorted(fps)
    df = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in enumerate(fps)], "rep long, fp long")
    edges = simhash.links(df, bits, chunk).collect()
    parent = np.arange(len(fps))
    if edges:
        unite(parent, np.array([e["a"] for e in edges]), np.array([e["b"] for e in edges]))
    linked = np.array([[bin(a ^ b).count("1") <= bits for b in fps] for a in fps])
    assert parent.tolist() == components(len(fps), linked, list(range(len(fps))))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, (1 << 64) - 1), st.integers(0, (1 << 64) - 1))
def test_manhattan_distance_is_a_lower_bound(a, b):
    counts = lambda x: [bin(x >> 2 * i & 3).count("1") for i in range(32)]
    point = lambda x: ((x | x >> 1) & simhash.LOW) | (x & x >> 1 & simhash.LOW) << 1
    manhattan = sum(abs(x - y) for x, y in zip(counts(a), counts(b), strict=True))
    assert bin(point(a) ^ point(b)).count("1") == manhattan <= bin(a ^ b).count("1")


def test_simhash_dedup(spark, make_docs, odd_texts):
    docs = make_docs(spark, odd_texts)
    kept = simhash.simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    groups = {r["doc_id"]: r["component_id"] for r in simhash.simhash_groups(docs).where("doc_id is not null").collect()}
    assert sorted(i for i in ids if i is not None) == sorted({i for i, c in groups.items() if i == c})
    assert ids.count(None) == 3
    assert simhash.simhash_dedup(docs.limit(0)).count() == 0


# --- substring


def plain_substring(rows, n):
    first = {}
    for i, t in rows:
        if i is not None and t:
            w = t.encode().split()
            for j in range(len(w) - n + 1):
                key = tuple(w[j : j + n])
                first[key] = min(first.get(key, i), i)
    out = []
    for i, t in rows:
        w = t.encode().split() if t else []
        gone = [False] * len(w)
        for j in range(len(w) - n + 1):
            if i is not None and first[tuple(w[j : j + n])] < i:
                gone[j : j + n] = [True] * n
        kept = b" ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), kept))
    return out


@pytest.mark.parametrize("length", [13, 2, 8, 30])
@pytest.mark.parametrize("group_bytes", [None, 500])
def test_substring_dedup(spark, make_docs, odd_texts, length, group_bytes):
    got = substring.substring_dedup(make_docs(spark, odd_texts), length, keep=["lang", "n_chars"], group_bytes=group_bytes).collect()
    rows = sorted(((r["doc_id"], r["n_words"], r["n_removed"], b" ".join((r["text"] or "").encode().split())) for r in got), key=str)
    assert rows == sorted(plain_substring(odd_texts, length), key=str)
    assert all((r["text"] is None) == (r["n_chars"] is None) for r in got) and sum(r["text"] is None for r in got) == 2


def test_substring_levels():
    assert substring.levels(13) == [4, 8, 13] and substring.levels(4) == [4] and substring.levels(50) == [4, 8, 16, 32, 50]


def test_substring_of_nothing(spark, make_docs):
    assert substring.substring_dedup(make_docs(spark, [(1, "a")]).limit(0)).count() == 0
    assert substring.substring_dedup(make_docs(spark, [(1, None), (2, "a b")])).count() == 2


# --- decontamination


def plain_decontaminate(rows, items, n):
    split = lambda t: bytes(c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in t.encode().lower()).split() if t else []
    windows = {}
    for i, t in items:
        w = split(t)
        if i is not None and w:
            m = min(n, len(w))
            for j in range(len(w) - m + 1):
                windows.setdefault(tuple(w[j : j + m]), set()).add(str(i))
    out = []
    for i, t in rows:
        w, names = split(t), set()
        hit = [False] * len(w)
        for m in {len(k) for k in windows}:
            for j in range(len(w) - m + 1):
                if found := windows.get(tuple(w[j : j + m])):
                    names |= found
                    hit[j : j + m] = [True] * m
        out.append((i, len(w), sum(hit), len(names), ",".join(sorted(names)), 0 < sum(hit) * 20 >= len(w) and sum(hit) > 0))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
@pytest.mark.parametrize("length,gram", [(13, 7), (5, 2), (3, 3)])
def test_decontaminate(spark, make_docs, odd_texts, block_bytes, length, gram):
    rows = odd_texts
    passage = " ".join(f"W{i}," for i in range(5, 40))
    items = [(1, passage), (2, "the, the; THE"), (10, "the the"), (3, None), (4, ""), (None, "a"), (5, rows[2][1] or "x"), (6, passage), (7, "a"), (8, "中文")]
    tests = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.decontaminate(make_docs(spark, rows), tests, length, gram, block_bytes, keep=["lang"]).collect()
    have = sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], ",".join(r["items"]), r["contaminated"]) for r in got), key=str)
    assert have == sorted(plain_decontaminate(rows, items, length), key=str)


def test_repeated_rows_keep_their_own_columns(spark):
    """With several blocks of test items, rows of one id and text that differ elsewhere, and the least id there is."""
    text, least = "a b c d e f g", -(1 << 63)
    rows = [(1, text, "x", 2**60 + 1), (1, text, "y", None), (least, text, "z", 3), (None, None, "n", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    items = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "d e f", "x y z", "q r s"])], "item_id long, text string")
    for block in (8, 1 << 20):
        got = decontaminate.decontaminate(docs, items, 3, 2, block, keep=["lang", "n_chars"]).collect()
        assert sorted((tuple(r)[:7] for r in got), key=lambda r: r[1]) == [(None, "n", 4, 0, 0, 0, []), (1, "x", 2**60 + 1, 7, 6, 2, ["0", "1"]), (1, "y", None, 7, 6, 2, ["0", "1"]), (least, "z", 3, 7, 6, 2, ["0", "1"])]
    assert sorted(r["doc_id"] for r in simhash.simhash_groups(docs).collect() if r["doc_id"] is not None) == [least, 1, 1]
    assert {r["doc_id"]: r["n_removed"] for r in substring.substring_dedup(docs, 3).where("doc_id is not null").collect()} == {least: 0, 1: 7}


def test_many_rows_of_one_item(spark):
    texts = [f"a{i} b{i} c{i} d{i}" for i in range(30)]
    items = spark.createDataFrame([(1, t) for t in texts] * 2, "item_id long, text string")
    held = [len(rows) for _, rows in decontaminate._blocks(items.selectExpr("'one' AS name", "CAST(text AS BINARY) AS t").distinct(), 60)]
    assert sum(held) == 30 and max(held) < 15
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = decontaminate.decontaminate(docs, items, 3, 2, 60).collect()
    assert all((r["n_hit"], r["items"]) == (4, ["1"]) for r in got) and len(got) == 30


def test_decontaminate_without_items(spark, make_docs, odd_texts):
    docs = make_docs(spark, odd_texts)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, none).where("contaminated or n_hit > 0").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0
    with pytest.raises(ValueError):
        decontaminate.decontaminate(docs, none, 5, 6)


def test_windows_that_share_the_first_hash():
    """Rows and answers of two windows with one first hash, as no text at hand has them."""
    h, other, doc = u64([5, 5, 5, 9]), u64([1, 1, 2, 7]), np.array([30, 10, 20, 40])
    rows = substring._rows(3, h, other, doc).to_pydict()
    assert rows["h"] == [5, 5, 9] and rows["least"] == [10, 20, 40]
    assert [(t >> 34, t >> 33 & 1, t >> 32 & 1, t & 0xFFFFFFFF) for t in rows["tag"]] == [(3, 1, 1, 1), (3, 1, 0, 2), (3, 0, 0, 7)]
    assert substring._match(u64([5, 5, 5, 9, 4, 10]), u64([1, 2, 3, 7, 1, 1]), u64([5, 5, 9]), np.array([1, 2, -1])).tolist() == [0, 1, -1, 2, -1, -1]
