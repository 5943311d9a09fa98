"""Words of many texts at once, as arrays: where they start and end, and a 64-bit hash of each.

A word's hash is a polynomial over its bytes' random 64-bit values, taken from running sums of a piece of text, so no
word becomes an object of its own. Two words of one hash are as likely as for any 64-bit hash.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame

from lexweave.llm._common import PRIME, mix

#: Bytes that are hashed at a time; longer words are hashed one by one.
PIECE = 1 << 16
_rng = np.random.default_rng(20)
VALUES = _rng.integers(1, 1 << 64, size=256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
LOWER_VALUES = VALUES[LOWER]
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


#: Powers of the multiplier and of its inverse (modulo 2^64), for any place in a piece and the words that begin in it.
UP, DOWN = _powers(PRIME, 2 * PIECE), _powers(pow(PRIME, -1, 1 << 64), 2 * PIECE)


@dataclass
class Words:
    """All words of a batch of texts. ``first``: the number of each text's first word, and at last that of all."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray
    hash: np.ndarray

    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow binary column; a null is empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if isinstance(column, pa.ChunkedArray):  # combine_chunks keeps several where one can't hold them
        column = pa.concat_arrays(column.cast(pa.large_binary()).chunks)
    if len(column) == 0:
        return np.empty(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    if column.null_count:
        column = column.fill_null(b"")
    wide = pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8) if column.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def find(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word (split at ASCII white space and between texts), and each text's first word."""
    if not len(data):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64), np.zeros(len(offsets), dtype=np.int64)
    inside = ~SPACE[data]
    edge = np.empty(len(data), dtype=bool)
    edge[0] = True
    np.logical_not(inside[:-1], out=edge[1:])
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    start = np.flatnonzero(edge & inside)
    edge[-1] = True
    np.logical_not(inside[1:], out=edge[:-1])
    edge[offsets[1:][offsets[1:] > 0] - 1] = True
    end = np.flatnonzero(edge & inside) + 1
    return start, end, np.searchsorted(start, offsets)


def hash_words(data: np.ndarray, start: np.ndarray, end: np.ndarray, values: np.ndarray = VALUES) -> np.ndarray:
    """Hash of data[start:end] for each word; starts ascend."""
    out = np.empty(len(start), dtype=np.uint64)
    at = np.searchsorted(start, np.arange(0, len(data) + PIECE, PIECE))
    sums = np.zeros(2 * PIECE + 1, dtype=np.uint64)
    for k in range(len(at) - 1):
        i, j = int(at[k]), int(at[k + 1])
        if i == j:
            continue
        long = end[j - 1] - start[j - 1] > PIECE  # only the last can leave the piece
        stop = j - long
        if stop > i:
            low, high = int(start[i]), int(end[stop - 1])
            np.multiply(values[data[low:high]], UP[: high - low], out=sums[1 : high - low + 1])
            np.cumsum(sums[1 : high - low + 1], out=sums[1 : high - low + 1])
            s = start[i:stop] - low
            out[i:stop] = (sums[end[i:stop] - low] - sums[s]) * DOWN[s]
        if long:
            out[stop] = xxhash.xxh3_64_intdigest((LOWER[data[start[stop] : end[stop]]] if values is LOWER_VALUES else data[start[stop] : end[stop]]).tobytes())
    return mix(out)


def words_in(column, lower: bool = False) -> Words:
    """The words of an Arrow binary column; ``lower``: A-Z count as a-z."""
    data, offsets = texts_of(column)
    start, end, first = find(data, offsets)
    return Words(data, start, end, first, hash_words(data, start, end, LOWER_VALUES if lower else VALUES))


def squeezed(df: DataFrame, column: str = "raw") -> DataFrame:
    """``df`` with each value of a binary column compressed by itself, which takes a third less in an exchange than what
    exchanges are compressed by; for text that is read from one exchange several times."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=1, write_checksum=False).compress
        for batch in batches:
            at = batch.schema.get_field_index(column)
            yield batch.set_column(at, column, pa.array([None if x is None else pack(x) for x in batch.column(at).to_pylist()], pa.binary()))

    return df.mapInArrow(run, df.schema)


def unsqueezed(column) -> pa.Array:
    """The values of a column that ``squeezed`` has made."""
    unpack = zstandard.ZstdDecompressor().decompress
    return pa.array([None if x is None else unpack(x) if x else b"" for x in column.to_pylist()], pa.binary())
