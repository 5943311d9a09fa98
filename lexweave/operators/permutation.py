"""A keyed permutation of 0..n-1 that is computed number by number: no sort, no exchange, and an inverse.

Four Feistel rounds permute the numbers of an even number of bits that hold n; what lands at n or beyond is permuted again until
it lands below (cycle walking), which keeps the whole a permutation and takes under four turns on average.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F

from lexweave.functions.hashing import _mix

ROUNDS = 4


def half_bits(n: int) -> int:
    """Bits of half a number."""
    return max(1, (max(1, n - 1).bit_length() + 1) // 2)


def _round(x: np.ndarray, key: int, turn: int) -> np.ndarray:
    return _mix(x ^ _mix(np.array([(key + turn) % (1 << 64)], dtype=np.uint64)))


def _walk(x: np.ndarray, n: int, once) -> np.ndarray:
    out = np.zeros(len(x), dtype=np.uint64)
    at, x = np.arange(len(x)), x.astype(np.uint64)
    if len(x) and int(x.max()) >= n:
        raise ValueError(f"{int(x.max())} lies outside of 0..{n - 1}")
    while len(at):
        x = once(x)
        done = x < np.uint64(n)
        out[at[done]] = x[done]
        at, x = at[~done], x[~done]
    return out.astype(np.int64)


def permuted(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """Where each number of 0..n-1 goes."""
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for turn in range(ROUNDS):
            left, right = right, left ^ (_round(right, key, turn) & mask)
        return (left << bits) | right

    return _walk(x, n, once)


def restored(x: np.ndarray, n: int, key: int) -> np.ndarray:
    """What goes to each number."""
    bits = np.uint64(half_bits(n))
    mask = np.uint64((1 << int(bits)) - 1)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for turn in reversed(range(ROUNDS)):
            left, right = right ^ (_round(left, key, turn) & mask), left
        return (left << bits) | right

    return _walk(x, n, once)


def permute(x: Column, n: int, key: int, inverse: bool = False) -> Column:
    """The same of a column of longs; null for null."""
    step = restored if inverse else permuted

    @F.arrow_udf("long")
    def run(numbers: pa.Array) -> pa.Array:
        known = numbers.is_valid().to_numpy(zero_copy_only=False)
        out = np.zeros(len(numbers), dtype=np.int64)
        out[known] = step(numbers.drop_null().to_numpy(zero_copy_only=False), n, key)
        return pa.array(out, mask=~known)

    return run(x.cast("long"))
