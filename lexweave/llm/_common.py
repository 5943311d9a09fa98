"""What the operators of this package share: reading tables, words, window hashes, forests of links."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lexweave.functions.memory import release as release
from lexweave.plans.session import shuffle_partitions

#: The odd multiplier of the window hashes (64 bits, wrapping).
PRIME = 0x9E3779B97F4A7C15
#: Bytes of text that one Python group holds at most on average.
GROUP_BYTES = 6 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def n_groups(docs: DataFrame, text: str = "text", group_bytes: int = GROUP_BYTES) -> int:
    """How many groups keep each near ``group_bytes`` of text; it follows the input's size."""
    total = docs.agg(F.sum(F.octet_length(text)).alias("b")).first()["b"] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-int(total) // group_bytes))


def with_columns(batch: pa.RecordBatch, keep: list[str], **columns: pa.Array) -> pa.RecordBatch:
    """The ``keep`` columns of a batch as they are, nulls and wide numbers included, and new ones."""
    return pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *columns.values()], [*keep, *columns])


def group_of(groups: int, *cols: str) -> Column:
    """A group by hash: even whatever the sources, and the same when a lost task runs again."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(groups)).cast("int")


class WordHashes(dict):
    """64-bit hashes of words, kept for words seen again; it starts anew when it has ``most`` words."""

    def __init__(self, most: int = 150_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > self.most:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every bit (finalizer of SplitMix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def window_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """Hash of each window of ``length`` items, from windows of powers of two."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    out, done, size, part = None, 0, 1, h
    while True:
        if length & size:
            piece = part[done : done + n]
            out = piece.copy() if out is None else out * np.uint64(pow(PRIME, size, 1 << 64)) + piece
            done += size
        if done == length:
            return mix(out)
        part = part[:-size] * np.uint64(pow(PRIME, size, 1 << 64)) + part[size:]
        size *= 2


def sliding_min(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours."""
    size = 1
    while 2 * size <= width:
        h = np.minimum(h[:-size], h[size:])
        size *= 2
    return np.minimum(h[: len(h) - (width - size)], h[width - size :]) if width > size else h


class HashSet:
    """A sorted table of hashes; a bit table of their low bits tells most misses."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.uint64((1 << max(12, min(24, int(len(table)).bit_length() + 3))) - 1)
        self.seen = np.zeros(int(self.bits) + 1, dtype=bool)
        self.seen[table & self.bits] = True

    def has(self, x: np.ndarray) -> np.ndarray:
        out = self.seen[x & self.bits]
        at = np.flatnonzero(out)
        if len(at):
            y = x[at]
            i = np.searchsorted(self.table, y)
            i[i == len(self.table)] = 0
            out[at] = self.table[i] == y
        return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` positions lie in a window of ``length`` at one of ``starts``."""
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, np.minimum(starts + length, n), -1)
    return np.cumsum(edge[:n]) > 0


def unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the trees of a[i] and b[i] in place; ``parent`` is flat before and after, roots are the smallest."""
    while True:
        pa, pb = parent[a], parent[b]
        open_ = pa != pb
        if not open_.any():
            return
        a, b, pa, pb = a[open_], b[open_], pa[open_], pb[open_]
        np.minimum.at(parent, np.maximum(pa, pb), np.minimum(pa, pb))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def whole_cells(batches, key: str, rows: int = 1 << 18):
    """Frames of whole cells, from frames that are sorted by ``key``: a cell that a frame ends in waits for the next."""
    held, n = [], 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        n += len(batch)
        if n < rows:
            continue
        frame = pd.concat(held) if len(held) > 1 else held[0]
        k = frame[key].to_numpy()
        at = int(np.searchsorted(k, k[-1], "left"))
        if at:
            yield frame.iloc[:at]
        held, n = [frame.iloc[at:]], len(frame) - at
    if held:
        yield pd.concat(held) if len(held) > 1 else held[0]


def forest(parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The links that ``unite`` has left: each node that isn't a root, and its root."""
    node = np.flatnonzero(parent != np.arange(len(parent)))
    return node, parent[node]
