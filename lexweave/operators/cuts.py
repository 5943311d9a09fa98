"""Where batches end, for any number of kinds of lengths.

The rule goes over a split's length cells in order and carries one open batch from cell to cell. What a block of cells does to
it is a function of how many items the open batch has when the block begins: they are the last ones before, which also
tells their longest side. So each block tabulates that function for itself (a row for each number up to batch_size), the
functions of neighbouring blocks are composed by pointer doubling in joins, and each block then goes over its own cells
from the batch that is open there. Nothing is gathered, and no task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from lexweave.operators.indexing import dense_index
from lexweave.plans.session import cut

#: Cells of a block; at least as many as the items of a batch, so that an open batch began in the block before at the earliest.
BLOCK = 4096
CELLS = "split string, src_len int, tgt_len int, start long, batch long, filled long, room long, full long"


def rule(filled, longest, own: int, n: int, batch_size: int, max_tokens: int):
    """What a cell of ``n`` items, ``own`` tokens wide, does to an open batch (its items and its longest side, numbers or
    arrays): room (items that still join it), batches that begin after it, and the batch that is open then."""
    full = max(1, min(batch_size, max_tokens // own))
    most = np.maximum(longest, own) if np.ndim(filled) else max(longest, own)
    if np.ndim(filled):
        room = np.where(filled > 0, np.minimum(n, np.maximum(0, np.minimum(batch_size, max_tokens // most) - filled)), min(n, full))
        rest = n - room
        return room, -(-rest // full), np.where(rest > 0, (rest - 1) % full + 1, filled + n), np.where(rest > 0, own, most)
    room = min(n, max(0, min(batch_size, max_tokens // most) - filled)) if filled else min(n, full)
    rest = n - room
    return (room, -(-rest // full), (rest - 1) % full + 1, own) if rest else (room, 0, filled + n, most)


def go(cells, batch_size: int, max_tokens: int, batch: int = 0, filled: int = 0, longest: int = 0, start: int = 0):
    """For each (src_len, tgt_len, items) in order: start, batch, filled, room, full."""
    for s, t, n in cells:
        own = max(s, t)
        room, new, after, wide = rule(filled, longest, own, n, batch_size, max_tokens)
        yield start, batch, filled, room, max(1, min(batch_size, max_tokens // own))
        start, batch, filled, longest = start + n, batch + new, after, wide


def _longest(before: pd.DataFrame, batch_size: int) -> np.ndarray:
    """The longest side among the last k items before a block, for k from 0 up to batch_size or what there is."""
    before = before.sort_values("no", ascending=False)
    wide = np.maximum(before["src_len"], before["tgt_len"]).to_numpy()
    n = np.minimum(before["n"].to_numpy(), batch_size)
    last = np.repeat(wide, n)[:batch_size]
    return np.concatenate([[0], np.maximum.accumulate(last)]).astype(np.int64) if len(last) else np.zeros(1, dtype=np.int64)


def distributed_cells(counts: DataFrame, batch_size: int, max_tokens: int, block: int = BLOCK) -> DataFrame:
    """The cells of CELLS from counts (split, src_len, tgt_len, n), by the rule that ``go`` states."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    block = max(block, batch_size)
    numbered = dense_index(counts.select("split", "src_len", "tgt_len", "n"), ["src_len", "tgt_len"], "no", within=["split"])
    own = F.floor(F.col("no") / block).cast("long")
    late = F.pmod("no", F.lit(block)) >= block - batch_size  # the next block may begin inside a batch of these
    both = F.array(F.struct(own.alias("block"), F.lit(False).alias("before")), F.struct((own + 1).alias("block"), F.lit(True).alias("before")))
    dealt = cut(numbered.select("split", "src_len", "tgt_len", "n", "no", F.inline(F.when(late, both).otherwise(F.slice(both, 1, 1)))))

    def tabulate(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        longest = _longest(group[group["before"]], batch_size)
        cells = group[~group["before"]].sort_values("no")
        first = np.arange(len(longest))
        filled, added = first.copy(), np.zeros(len(first), dtype=np.int64)
        for s, t, n in zip(cells["src_len"].tolist(), cells["tgt_len"].tolist(), cells["n"].tolist(), strict=True):
            _, new, filled, longest = rule(filled, longest, max(s, t), n, batch_size, max_tokens)
            added = added + new
        if not len(cells):  # after the last block
            return pd.DataFrame(columns=["split", "block", "filled", "next", "after", "added", "items"])
        return pd.DataFrame({"split": key[0], "block": key[1], "filled": first, "next": key[1] + 1, "after": filled, "added": added, "items": int(cells["n"].sum())}).astype({"split": object})

    jumps = cut(dealt.groupBy("split", "block").applyInPandas(tabulate, "split string, block long, filled long, next long, after long, added long, items long"))
    zero = F.lit(0).cast("long")
    met = dealt.where("no = 0 AND NOT before").select("split", zero.alias("block"), zero.alias("filled"), zero.alias("batch"), zero.alias("start"))
    while not jumps.isEmpty():  # after k rounds: the first 2^k blocks of each split, and what 2^k blocks do together
        far = met.join(jumps, ["split", "block", "filled"]).select("split", F.col("next").alias("block"), F.col("after").alias("filled"), (F.col("batch") + F.col("added")).alias("batch"), (F.col("start") + F.col("items")).alias("start"))
        met = cut(met.unionByName(far))
        then = jumps.select("split", F.col("block").alias("next"), F.col("filled").alias("after"), F.col("next").alias("next2"), F.col("after").alias("after2"), F.col("added").alias("added2"), F.col("items").alias("items2"))
        jumps = cut(jumps.join(then, ["split", "next", "after"]).select(
            "split", "block", "filled", F.col("next2").alias("next"), F.col("after2").alias("after"), (F.col("added") + F.col("added2")).alias("added"), (F.col("items") + F.col("items2")).alias("items")
        ))

    def place(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        longest, cells = _longest(group[group["before"]], batch_size), group[~group["before"]].sort_values("no")
        if not len(cells):
            return pd.DataFrame(columns=[c.split(" ")[0] for c in CELLS.split(", ")])
        filled = int(cells["filled"].iloc[0])
        lengths = list(zip(cells["src_len"].tolist(), cells["tgt_len"].tolist(), cells["n"].tolist(), strict=True))
        rows = go(lengths, batch_size, max_tokens, int(cells["batch"].iloc[0]), filled, int(longest[filled]), int(cells["start"].iloc[0]))
        return pd.DataFrame([(key[0], s, t, *r) for (s, t, _), r in zip(lengths, rows, strict=True)], columns=[c.split(" ")[0] for c in CELLS.split(", ")]).astype({"split": object})

    return dealt.join(met, ["split", "block"]).groupBy("split", "block").applyInPandas(place, CELLS)
