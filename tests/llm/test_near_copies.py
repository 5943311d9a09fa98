"""The pipeline's near copies against brute-force Jaccard groups."""

import corpus_pipeline
import numpy as np
import pytest

from lexweave.llm import near_copies


def plain_set(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def plain_groups(rows):
    """doc_id -> smallest doc_id, by all pairs."""
    sets, label = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if label[i] != label[j] and (a == b or 5 * len(a & b) >= 4 * len(a | b)):
                label = [label[j] if x == label[i] else x for x in label]
    least = {}
    for (i, _), x in zip(rows, label, strict=True):
        least[x] = min(i, least.get(x, i))
    return {i: least[x] for (i, _), x in zip(rows, label, strict=True)}


def edited():
    """Texts of 4 to 300 words and copies with words changed, cut or added: similarities on both sides of 0.8, and chains."""
    rng = np.random.default_rng(8)
    out = []
    for k in range(60):
        words = [f"w{x}" for x in rng.integers(0, 5000, size=int(rng.integers(4, 300)))]
        out.append(" ".join(words))
        for _ in range(5):
            copy = words if rng.random() < 0.7 else out[-1].split()
            copy = list(copy)
            for at in rng.integers(0, len(copy), size=int(rng.integers(0, 2 + len(copy) // 30))):
                copy[at] = f"x{rng.integers(0, 1 << 30)}"
            out.append(" ".join(copy[int(rng.integers(0, 4)) :] or copy))
    out += ["", None, " \n", "one two", "One  two", "one two three"]
    return [(int(i), t) for i, t in zip(rng.permutation(len(out)), out, strict=True)]


@pytest.mark.parametrize("chunk", [2048, 2])
def test_groups_are_those_of_all_pairs(spark, make_docs, chunk):
    rows = edited()
    want = plain_groups(rows)
    assert len(set(want.values())) < len({plain_set(t) for _, t in rows}) - 50  # many are no exact copies
    assert {r["doc_id"]: r["component_id"] for r in near_copies.near_copy_groups(make_docs(spark, rows), chunk).collect()} == want


def test_stage_keeps_one_of_each_group(spark, make_docs):
    rows = edited()
    docs = make_docs(spark, rows)
    kept = [r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()]
    assert sorted(kept) == sorted(set(plain_groups(rows).values()))
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_grid_makes_candidates_where_no_band_is_shared(spark):
    """Fingerprints within three bits, or equal ones, are in one block; others aren't."""
    fp = 0x0123456789ABCDEF
    rows = [(1, fp), (2, fp ^ 0b111), (3, fp), (4, fp ^ (0xFF << 40)), (5, fp ^ (0xFF << 40) ^ (1 << 62))]
    classes = spark.createDataFrame([(i, f, []) for i, f in rows], "rep long, fp long, cells array<long>")
    edges = near_copies.candidates(classes)
    found = near_copies.connected_components(edges, "a", "b").collect()
    assert {r["node"]: r["component"] for r in found} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_embedded_points_bound_the_distance():
    a, b = np.random.default_rng(5).integers(0, 1 << 64, size=(2, 5000), dtype=np.uint64)
    count = lambda x: [(bin(int(v) >> s & 3).count("1")) for v in x[:50] for s in range(0, 64, 2)]
    manhattan = np.abs(np.subtract(count(a), count(b))).reshape(50, 32).sum(axis=1)
    got = np.bitwise_count(near_copies.embedded(a) ^ near_copies.embedded(b))
    assert got[:50].tolist() == manhattan.tolist() and (got <= np.bitwise_count(a ^ b)).all()
