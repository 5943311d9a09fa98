"""Stable 64-bit hashes. Unsigned values travel as two 32-bit limbs or as the bit pattern of a BIGINT."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

MASK = (1 << 32) - 1
#: FNV-1a, 64 bits.
BASIS, PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)


@F.pandas_udf(T.LongType())
def _fnv1a64(data: pd.Series) -> pd.Series:
    """All rows of a batch at once, one byte position after the other; the longest rows come first, so that those
    which go on are always a prefix."""
    lengths = np.fromiter((0 if b is None else len(b) for b in data), dtype=np.int64, count=len(data))
    raw = np.frombuffer(b"".join(b for b in data if b), dtype=np.uint8).astype(np.uint64)
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    going = len(data) - np.searchsorted(np.sort(lengths), np.arange(lengths.max(initial=0)), side="right")
    h = np.full(len(data), BASIS)
    for place, n in enumerate(going.tolist()):
        h[:n] = (h[:n] ^ raw[starts[:n] + place]) * PRIME
    out = np.empty(len(data), dtype=np.uint64)
    out[order] = h
    return pd.Series(out.view(np.int64), dtype="Int64").where(data.notna().to_numpy())


def fnv1a64(data: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes (or of binary) as struct(hi, lo); null for null. Arrow batches: a higher-order
    function over bytes on the JVM took about 30 times as long."""
    bits = _fnv1a64(data.cast("binary"))
    return F.when(bits.isNotNull(), F.struct(F.shiftrightunsigned(bits, 32).alias("hi"), bits.bitwiseAND(F.lit(MASK)).alias("lo")))


def limbs_mod(h: Column, m: int) -> Column:
    """struct(hi, lo) as an unsigned number, modulo a small m."""
    return F.pmod(F.pmod(h["hi"], F.lit(m)) * ((1 << 32) % m) + h["lo"], F.lit(m))


def limbs_hex(h: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(h["hi"]), 8, "0"), F.lpad(F.hex(h["lo"]), 8, "0")))


def _mix(z: np.ndarray) -> np.ndarray:
    z = z + np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


@F.pandas_udf(T.LongType())
def splitmix64(x: pd.Series) -> pd.Series:
    """SplitMix64 of a BIGINT's bit pattern, as a bit pattern (wrapping products, which ANSI mode forbids on the JVM)."""
    return pd.Series(_mix(x.to_numpy(dtype=np.int64).view(np.uint64)).view(np.int64))


def seeded(x: Column, seed: int) -> Column:
    """SplitMix64 of x xor seed: a total order over distinct x."""
    return splitmix64(x.cast("long").bitwiseXOR(F.lit(seed).cast("long")))


def unsigned_order(bits: Column) -> Column:
    """A BIGINT that sorts as the unsigned number with these bits."""
    return bits.bitwiseXOR(F.lit(-(1 << 63)))
