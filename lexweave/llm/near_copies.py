"""Near copies by SimHash fingerprints of five-word shingles, verified by Jaccard similarity.

Two texts are near copies if the sets of their shingles have a Jaccard similarity of 0.8 or more. At 0.8 a bit of two
fingerprints differs with a probability of about 0.15 (0.19 for texts of four or five shingles), so RADIUS holds all but
about one pair in ten thousand. Candidates within GRID_BITS come from the segment-popcount embedding and its grid join, as in
``simhash``. No grid over 64 bits is selective at RADIUS; texts that share a MinHash band are therefore candidates too (a
pair at 0.8 shares none of the BANDS with a probability of 5e-5). A block is a component of candidates. In it the Manhattan
distance of the embedded points is tested first, then the Hamming distance, the sets last; a set that is linked already
isn't compared again. A large block is dealt into chunks, and pairs of chunks go to different tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexweave.llm._common import forest, mix, release, unite
from lexweave.llm import simhash
from lexweave.llm.simhash import keep_first
from lexweave.operators.graph import connected_components
from lexweave.plans.session import cut

SHINGLE = 5
#: Near copies have at least so many fifths of their shingles in common (0.8).
FIFTHS = 4
RADIUS = 24
GRID_BITS = 3
BANDS, ROWS = 25, 5
#: Members of a block that one task compares with each other; more are dealt out in chunks of this size.
CHUNK = 2048
_rng = np.random.default_rng(11)
FLIP, FACTOR = (_rng.integers(0, 1 << 64, size=BANDS * ROWS, dtype=np.uint64) for _ in range(2))
FACTOR = FACTOR | np.uint64(1)


def shingles(raw: bytes | None) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles (words as in ``simhash.fingerprint``; a shorter text is one)."""
    words = raw.lower().split() if raw else []
    if not words:
        return np.empty(0, dtype=np.uint64)
    n, step, digest = max(1, len(words) - SHINGLE + 1), 1 << 16, xxhash.xxh64_intdigest
    parts = [
        np.fromiter((digest(b" ".join(words[i : i + SHINGLE]), 42) for i in range(s, min(n, s + step))), dtype=np.uint64, count=min(n, s + step) - s)
        for s in range(0, n, step)
    ]
    return np.unique(np.concatenate(parts))


def fingerprint(own: np.ndarray) -> int:
    votes = np.zeros(64, dtype=np.int64)
    for s in range(0, len(own), 1 << 16):
        votes += np.unpackbits(own[s : s + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(own), bitorder="little").view("<u8")[0])


def bands(own: np.ndarray) -> np.ndarray:
    """A hash for each band of minima; none for an empty set."""
    if not len(own):
        return np.empty(0, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for s in range(0, len(own), 512):
        x = own[None, s : s + 512] ^ FLIP[:, None]
        x *= FACTOR[:, None]
        np.minimum(least, x.min(axis=1), out=least)
    key = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        key = mix(key ^ column) + np.uint64(1)
    return key.view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, set (a hash of the whole set of shingles), fp (its fingerprint), cells (its bands), for each row with a doc_id."""

    def run(batches):
        for batch in batches:
            sets = [shingles(raw) for raw in batch["raw"]]
            whole = np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], dtype=np.uint64).view(np.int64)
            fp = np.array([fingerprint(s) if len(s) else 0 for s in sets], dtype=np.uint64).view(np.int64)
            cells = [bands(s) for s in sets]
            release()
            yield pd.DataFrame({"doc_id": batch["doc_id"], "set": whole, "fp": fp, "cells": cells})

    source = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return source.mapInPandas(run, "doc_id long, set long, fp long, cells array<long>")


def sharing(cells: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are those of all ``rep`` that share a ``cell``."""

    def run(batches):
        last = None
        for rows in batches:
            cell, rep = rows["cell"].to_numpy(), rows["rep"].to_numpy()
            if last is not None:  # a cell may go on from the batch before: its last row stands for it
                cell, rep = np.concatenate([[last[0]], cell]), np.concatenate([[last[1]], rep])
            if not len(cell):
                continue
            last = cell[-1], rep[-1]
            name, rep = np.unique(rep, return_inverse=True)
            at = np.flatnonzero(cell[1:] == cell[:-1])
            parent = np.arange(len(name))
            unite(parent, rep[at], rep[at + 1])
            node, root = forest(parent)
            yield pd.DataFrame({"a": name[node], "b": name[root]})

    return cells.repartition("cell").sortWithinPartitions("cell").mapInPandas(run, "a long, b long")


def candidates(classes: DataFrame) -> DataFrame:
    """Edges (a, b) whose components are the blocks. ``classes``: rep, fp, cells, one row for each set; two are in one block if
    their fingerprints lie within GRID_BITS, by the grid join over embedded points, or if they share a band."""
    prints = classes.groupBy("fp").agg(F.min("rep").alias("first"))
    equal = classes.join(prints, "fp").select(F.col("rep").alias("a"), F.col("first").alias("b")).where("a <> b")
    grid = simhash.links(prints.select("fp", F.col("first").alias("rep")), GRID_BITS)
    return sharing(classes.select("rep", F.explode("cells").alias("cell"))).unionByName(equal).unionByName(grid)


def embedded(fp: np.ndarray) -> np.ndarray:
    """``simhash.embedded`` of an array."""
    low, high = np.uint64(simhash.LOW), fp >> np.uint64(1)
    return ((fp | high) & low) | ((fp & high & low) << np.uint64(1))


def linked(sets: list[np.ndarray]) -> np.ndarray:
    """Parent array of the forest of all near copies among ``sets``."""
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    fp = np.array([fingerprint(s) for s in sets], dtype=np.uint64)
    point = embedded(fp)
    names, item = np.unique(np.concatenate(sets), return_inverse=True)
    has, parent = np.zeros(len(names), dtype=bool), np.arange(len(sets))
    for i in range(len(sets) - 1):
        size = sizes[i]
        later = slice(i + 1, None)
        fits = (np.bitwise_count(point[later] ^ point[i]) <= RADIUS) & (np.bitwise_count(fp[later] ^ fp[i]) <= RADIUS)
        fits &= parent[later] != parent[i]
        fits &= 5 * np.minimum(sizes[later], size) >= FIFTHS * np.maximum(sizes[later], size)
        others = np.flatnonzero(fits) + i + 1
        if not len(others):
            continue
        own = item[starts[i] : starts[i] + size]
        has[own] = True
        for s in range(0, len(others), 256):
            part = others[s : s + 256]
            n = sizes[part]
            first = np.cumsum(n) - n
            common = np.add.reduceat(has[item[np.repeat(starts[part] - first, n) + np.arange(n.sum())]], first, dtype=np.int64)
            near = part[5 * common >= FIFTHS * (n + size - common)]
            if len(near):
                unite(parent, np.full(len(near), i), near)
        has[own] = False
    return parent


def links(texts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) whose components are those of all near copies inside a block. ``texts``: rep, block, raw."""
    crowded = (
        texts.groupBy("block").count().where(F.col("count") > chunk)
        .select("block", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    )
    own = F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = (
        texts.join(crowded, "block", "left")
        .withColumn("own", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(own))
        .withColumn("other", other)
        .select("rep", "raw", "block", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    )

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rep = pdf["rep"].to_numpy()
        node, root = forest(linked([shingles(raw) for raw in pdf["raw"]]))
        release()
        return pd.DataFrame({"a": rep[node], "b": rep[root]})

    return dealt.groupBy("block", "low", "high").applyInPandas(run, "a long, b long")


def near_copy_groups(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """One row for each row with a doc_id: doc_id, component_id, the smallest doc_id that near copies reach.

    Texts without words (null, empty, white space) are copies of each other. Sets are compared by 64-bit hashes.
    """
    rows = cut(sketches(docs))
    classes = cut(rows.groupBy("set").agg(F.min("doc_id").alias("rep"), F.first("fp").alias("fp"), F.first("cells").alias("cells")))
    blocks = connected_components(candidates(classes), "a", "b")
    source = docs.where("text is not null").select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("binary").alias("raw"))
    texts = source.join(blocks, F.col("rep") == F.col("node")).select("rep", F.col("component").alias("block"), "raw")
    named = connected_components(links(cut(texts), chunk), "a", "b")
    labels = classes.join(named, F.col("rep") == F.col("node"), "left").select("set", F.coalesce("component", "rep").alias("component_id"))
    return rows.select("doc_id", "set").join(labels, "set", "left").select("doc_id", "component_id")


def near_copy_dedup(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each group the one with the smallest doc_id; repeated and null ids as in
    ``simhash.simhash_dedup``."""
    return keep_first(docs, near_copy_groups(docs))
