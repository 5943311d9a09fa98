"""Embedding whitening: the covariance from one aggregation over every pair of dimensions, its eigenvectors from LAPACK.

Entries become integers, and the sums of products are taken around integer centres, so they are exact: the same rows give the
same covariance whatever their order, their partitions and the tasks that run again. Only numbers that depend on the
dimensions, never on the rows, reach the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.llm._common import read
from lexweave.plans.session import cut

#: Steps of a component, and the integer that zero becomes.
STEPS, ZERO = 64, 1_000_000
COMPONENTS = 32
#: Sums that one aggregation has at most: all pairs of 90 dimensions. Wider vectors take several aggregations.
SUMS = 4096
#: Rows that a task of the aggregation reads at least: its code takes a second or two to make and to compile, whatever the rows.
ROWS_A_TASK = 1 << 14
#: Doubles hold integers up to here exactly, and their sums are the cheaper ones.
EXACT = 1 << 53
#: Eigenvalues up to this share of the trace are zero but for rounding.
NO_SPREAD = 1e-11
#: Rows that are projected at a time.
ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with sums ``total`` by dimension; the covariance's ``components`` by falling ``eigenvalue``, one a row; the
    sum of all eigenvalues. A component without spread has nulls for coordinates."""

    n: int
    total: list[int]
    components: np.ndarray
    eigenvalue: np.ndarray
    trace: float

    @property
    def spread(self) -> np.ndarray:
        return self.eigenvalue > NO_SPREAD * self.trace

    @property
    def centre(self) -> list[int]:
        """The integers nearest to the means."""
        return [_nearest(s, self.n) for s in self.total]

    def deviation(self, off: np.ndarray) -> np.ndarray:
        """Sum of (n x - total)^2 over the dimensions for rows of x - centre, exact."""
        rest = np.array([s - self.n * c for s, c in zip(self.total, self.centre, strict=True)], dtype=np.float64)
        if off.size and ((self.n * off.astype(np.float64) - rest) ** 2).sum(axis=1).max() >= 2.0**62:
            raise OverflowError("a deviation over 64 bits")
        return ((self.n * off - rest.astype(np.int64)) ** 2).sum(axis=1)

    def project(self, off: np.ndarray) -> np.ndarray:
        """Coordinates of rows of x - centre."""
        rest = np.array([(s - self.n * c) / self.n for s, c in zip(self.total, self.centre, strict=True)])
        ok = self.spread
        scaled = self.components[ok] / np.sqrt(self.eigenvalue[ok])[:, None]
        out = np.full((len(off), len(ok)), np.nan)
        out[:, ok] = (off - rest) @ scaled.T
        return out


def _nearest(total: int, n: int) -> int:
    return (2 * total + n) // (2 * n)


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id, x: the integers of each vector without null or non-finite entries."""
    bad = lambda c: c.isNull() | F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf")))
    named = rows.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    sound = named.where(F.col("e").isNotNull() & ~F.coalesce(F.exists("e", bad), F.lit(False)))
    return sound.select("vec_id", F.transform("e", lambda c: F.floor(c * STEPS).cast("long") + ZERO).alias("x"))


def _sums(df: DataFrame, sums: Iterator[str]) -> list:
    """The values of the SQL aggregates over all rows, as many as an aggregation takes at a time."""
    out = []
    while block := list(islice(sums, SUMS)):
        out += df.selectExpr(f"array({', '.join(block)}) AS sums").first()["sums"]
    return out


def upper_triangle(df: DataFrame, parts: list[Column], rows: int) -> np.ndarray:
    """Sums of the products of every two of the columns, which have no nulls, over about so many rows: the upper triangle is
    summed in one aggregation and mirrored."""
    named = df.select(*[p.alias(f"p{i}") for i, p in enumerate(parts)]).coalesce(max(1, -(-rows // ROWS_A_TASK)))
    pairs = list(combinations_with_replacement(range(len(parts)), 2))
    out = np.zeros((len(parts), len(parts)), dtype=object)
    for (i, j), s in zip(pairs, _sums(named, (f"sum(p{i} * p{j})" for i, j in pairs)), strict=True):
        out[i, j] = out[j, i] = s
    return out


def fit(vectors: DataFrame, width: int, most: int = COMPONENTS) -> Whitening | None:
    """The whitening of the vectors (x) of one width; None if there are none."""
    n, *total = _sums(vectors, iter(["count(*)", *[f"sum(x[{i}])" for i in range(width)]]))
    if not n or not width:
        return None
    centre = [_nearest(s, n) for s in total]
    spread = "greatest(0L, " + ", ".join(f"max(abs(x[{i}] - {m}L))" for i, m in enumerate(centre)) + ")"
    most_off = _sums(vectors, iter([spread]))[0]
    kind = "double" if n * most_off * most_off < EXACT else "long"
    parts = [F.coalesce(F.get("x", F.lit(i)) - F.lit(m), F.lit(0)).cast(kind) for i, m in enumerate(centre)]
    products = upper_triangle(vectors, parts, n)
    products = np.vectorize(int, otypes=[object])(products)
    rest = [s - n * m for s, m in zip(total, centre, strict=True)]
    covariance = np.array([[(n * products[i, j] - rest[i] * rest[j]) / (n * n) for j in range(width)] for i in range(width)], dtype=np.float64)
    value, vector = np.linalg.eigh(covariance)
    components = vector.T[::-1][:most]
    largest = np.abs(components).argmax(axis=1)  # one sign, whatever LAPACK has chosen
    components = components * np.where(components[np.arange(len(components)), largest] < 0, -1.0, 1.0)[:, None]
    return Whitening(n, total, components, np.maximum(value[::-1][:most], 0.0), float(np.trace(covariance)))


def whiten(vectors: DataFrame, fitted: Whitening) -> DataFrame:
    """vec_id, deviation, w (coordinates by component) of each vector."""
    centre = np.array(fitted.centre, dtype=np.int64)

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                batch = whole.slice(at, ROWS)
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(centre))
                off = x - centre
                w = fitted.project(off)
                flat = pa.array(w.ravel(), mask=np.isnan(w).ravel())
                offsets = pa.array(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(fitted.deviation(off)), pa.ListArray.from_arrays(offsets, flat)], ["vec_id", "deviation", "w"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return vectors.mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(whitened: DataFrame, fitted: Whitening) -> float:
    """Largest entry of the coordinates' covariance minus the identity, measured over all rows."""
    at = np.flatnonzero(fitted.spread)
    if not len(at):
        return 0.0
    means = [s / fitted.n for s in _sums(whitened, (f"sum(w[{k}])" for k in at))]
    parts = [F.coalesce(F.get("w", F.lit(int(k))) - F.lit(m), F.lit(0.0)) for k, m in zip(at, means, strict=True)]
    products = upper_triangle(whitened, parts, fitted.n).astype(np.float64)
    return float(np.abs(products / fitted.n - np.eye(len(at))).max())


def whitened_embeddings(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each usable vector and component.

    Vectors that are null or hold null or non-finite entries are left out, and empty ones have no component. Vectors of
    different widths have nothing to be compared by: each width is fitted by itself, with its own n. Repeated rows count as
    often as they are there and give rows each; a null vec_id counts and stays null. A component whose eigenvalue is zero but for
    rounding (a single vector, equal vectors, a constant dimension) has a null ``whitened`` and is no part of the
    identity; with no spread at all ``explained`` is null. An empty table gives no rows. Other columns are not read. Entries or deviations that 64
    bits can't hold fail the query instead of wrapping.
    """
    vectors = usable(rows, vec_id, embedding)
    widths = [r["d"] for r in vectors.groupBy(F.size("x").alias("d")).count().where("d > 0").orderBy("d").collect()]  # kinds of widths
    out = None
    for width in widths:
        own = vectors.where(F.size("x") == width)
        fitted = fit(own, width, most)
        coordinates = cut(whiten(own, fitted))
        error = identity_error(coordinates, fitted)
        share = fitted.eigenvalue / fitted.trace if fitted.trace > 0 else [None] * len(fitted.eigenvalue)
        explained = F.array(*[F.lit(None if s is None else float(s)).cast("double") for s in share])
        part = coordinates.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened")).select(
            "vec_id", (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
            F.get(explained, F.col("k")).alias("explained"), F.lit(error).alias("identity_error"),
        )
        out = part if out is None else out.unionByName(part)
    if out is None:
        kind = vectors.schema["vec_id"].dataType.simpleString()
        return rows.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_embeddings(read(spark, sf_dir, "embeddings"))
