"""Whitening against numpy on the same integers."""

import math

import numpy as np
import pytest

from lexweave.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x array<long>, e string, w int, k int, component string, deviation string, n string"
EXTRA = (1, [7], "e", 2, 3, "c", "d", "n")


def frame(spark, rows):
    return spark.createDataFrame([(i, v, *EXTRA) for i, v in rows], SCHEMA)


def plain(vectors, most=32):
    """Integers, exact deviations, eigenvalues and components of equally wide vectors."""
    x = np.floor(64 * np.array(vectors, dtype=np.float32).astype(np.float64)).astype(np.int64) + 1_000_000
    n, total = len(x), x.sum(axis=0)
    deviation = [sum((n * int(a) - int(s)) ** 2 for a, s in zip(row, total, strict=True)) for row in x]
    off = x - total / n
    value, vector = np.linalg.eigh(off.T @ off / n)
    return deviation, value[::-1][:most], off @ vector[:, ::-1][:, :most], value.sum()


@pytest.mark.parametrize("width", [3, 40])
def test_like_numpy(spark, width):
    rng = np.random.default_rng(width)
    data = (rng.normal(size=(300, width)) @ rng.normal(size=(width, width))).astype(np.float32)
    data[7] = data[8]  # a repeated vector
    got = whitening.whitened_embeddings(frame(spark, [(i, v.tolist()) for i, v in enumerate(data)])).toPandas().sort_values(["vec_id", "component"])
    deviation, value, projected, trace = plain(data)
    k = min(width, 32)
    assert len(got) == 300 * k and set(got["n"]) == {300}
    assert got["deviation"].tolist() == [d for d in deviation for _ in range(k)]
    mine = got["whitened"].to_numpy().reshape(300, k)
    want = projected / np.sqrt(value)
    want *= np.sign((want * mine).sum(axis=0))
    assert np.abs(mine - want).max() < 1e-6
    assert np.allclose(got["explained"].to_numpy().reshape(300, k)[0], value / trace, rtol=1e-9)
    error = got["identity_error"].iloc[0]
    assert got["identity_error"].nunique() == 1 and error <= 1e-9 and abs(np.abs(mine.T @ mine / 300 - np.eye(k)).max() - error) < 1e-9


def test_unusable_and_other_widths(spark):
    inf, nan = math.inf, math.nan
    rows = [(0, [1.0, 2.0]), (1, [2.0, 0.5]), (2, [0.0, 0.0]), (2, [0.0, 0.0]), (None, [3.0, -1.0]), (3, None), (4, [1.0, None]), (5, [inf, 1.0]), (6, [nan, 1.0]), (7, [-inf, 0.0]),
            (8, []), (9, [1.0]), (10, [4.0]), (11, [1.0, 1.0, 1.0])]
    got = whitening.whitened_embeddings(frame(spark, rows)).collect()
    by_id = {}
    for r in got:
        by_id.setdefault(r["vec_id"], []).append(r)
    assert {i: len(v) for i, v in by_id.items()} == {0: 2, 1: 2, 2: 4, None: 2, 9: 1, 10: 1, 11: 3}
    assert {r["n"] for r in by_id[0]} == {5} and {r["n"] for r in by_id[9]} == {2}
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in by_id[11])  # alone: no spread
    assert sorted(r["whitened"] for r in by_id[9] + by_id[10]) == pytest.approx([-1, 1])


def test_constant_dimension(spark):
    got = whitening.whitened_embeddings(frame(spark, [(0, [1.0, 5.0]), (1, [2.0, 5.0]), (2, [4.0, 5.0])])).collect()
    assert all((r["whitened"] is None) == (r["component"] == 2) for r in got) and {r["identity_error"] < 1e-9 for r in got} == {True}


def test_empty(spark):
    out = whitening.whitened_embeddings(frame(spark, []))
    assert out.count() == 0 and out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_many_aggregations_and_long_sums(spark, monkeypatch):
    """The same numbers whether the sums fit one aggregation or not, doubles or not."""
    rng = np.random.default_rng(3)
    vectors = whitening.usable(frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(60, 6)) * 50)]))
    want = whitening.fit(vectors, 6)
    monkeypatch.setattr(whitening, "SUMS", 4)
    monkeypatch.setattr(whitening, "EXACT", 0)
    got = whitening.fit(vectors.repartition(5), 6)
    assert got.total == want.total and (got.components == want.components).all() and (got.eigenvalue == want.eigenvalue).all()


def test_overflow_is_an_error():
    fitted = whitening.Whitening(1 << 40, [0, 0], np.eye(2), np.ones(2), 2.0)
    with pytest.raises(OverflowError):
        fitted.deviation(np.array([[1 << 20, 0]]))
