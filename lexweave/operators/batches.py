"""Batches of similar length under a token budget.

Items are ordered by length with a seeded tie-break. Where a batch ends depends only on the sequence of lengths, that is on the
counts of (source, target) cells. The rule goes over the cells and leaves, for each of them, how many of its items fill the
open batch and how many each further batch takes; every item then finds its batch from its cell and its place. Nothing
that grows with the items is gathered or broadcast, and many kinds of lengths are gone over in blocks (``cuts``).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.functions.hashing import seeded, unsigned_order
from lexweave.operators.cuts import CELLS, distributed_cells, go
from lexweave.operators.indexing import dense_index
from lexweave.operators.permutation import permute, restored
from lexweave.plans.session import cut

#: Cells up to so many are gone over on the driver and sent to every task (16,002 lie within the default lengths); more are
#: gone over in blocks and joined by shuffle, with the same result.
GATHERED_CELLS = 100_000


@dataclass(frozen=True)
class Cell:
    """Items of one (src_len, tgt_len): the first stands at ``start``; ``room`` of them join the batch ``batch``, which has
    ``filled`` items; each batch after it takes ``full``."""

    split: str
    src_len: int
    tgt_len: int
    start: int
    batch: int
    filled: int
    room: int
    full: int


def plan_cells(counts: list[tuple[int, int, int]], batch_size: int, max_tokens: int, split: str = "train") -> list[Cell]:
    """The cells of a split from their sorted (src_len, tgt_len, items). A batch is full at ``batch_size`` items or when
    one more would take it, padded to its longest side, over ``max_tokens``; an item alone always fits."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")
    return [Cell(split, s, t, *r) for (s, t, _), r in zip(counts, go(counts, batch_size, max_tokens), strict=True)]


def cells_of(items: DataFrame, batch_size: int, max_tokens: int, gathered: int = GATHERED_CELLS) -> DataFrame:
    """The cells (CELLS) of items (split, src_len, tgt_len, ...)."""
    counted = cut(items.groupBy("split", "src_len", "tgt_len").agg(F.count("*").alias("n")))
    if counted.count() > gathered:
        return distributed_cells(counted, batch_size, max_tokens)
    counts: dict[str, list[tuple[int, int, int]]] = {}
    for r in counted.orderBy("split", "src_len", "tgt_len").collect():
        counts.setdefault(r["split"], []).append((r["src_len"], r["tgt_len"], r["n"]))
    cells = [c for split, own in counts.items() for c in plan_cells(own, batch_size, max_tokens, split)]
    return F.broadcast(items.sparkSession.createDataFrame([tuple(vars(c).values()) for c in cells], CELLS))


def bucket(items: DataFrame, batch_size: int, max_tokens: int, seed: int, gathered: int = GATHERED_CELLS) -> DataFrame:
    """``items`` (split, item_idx, src_len, tgt_len, ...) with ``batch_id``, dense from 0 in each split, and
    ``pos_in_batch``."""
    cells = cells_of(items, batch_size, max_tokens, gathered)
    keyed = items.withColumn("__tie", unsigned_order(seeded(F.col("item_idx"), seed)))
    placed = dense_index(keyed, ["src_len", "tgt_len", "__tie"], "__at", within=["split"]).drop("__tie")
    own = placed.join(cells, ["split", "src_len", "tgt_len"])
    offset = F.col("__at") - F.col("start")
    beyond = offset - F.col("room")
    joins = offset < F.col("room")
    return own.select(
        *items.columns,
        F.when(joins, F.col("batch")).otherwise(F.col("batch") + 1 + F.floor(beyond / F.col("full"))).cast("long").alias("batch_id"),
        F.when(joins, F.col("filled") + offset).otherwise(F.pmod(beyond, F.col("full"))).cast("long").alias("pos_in_batch"),
    )


def batch_stats(batched: DataFrame) -> DataFrame:
    """split, batches, largest_batch, real_tokens, padded_tokens."""
    each = batched.groupBy("split", "batch_id").agg(
        F.count("*").alias("n"), F.sum(F.col("src_len") + F.col("tgt_len")).alias("real"), (F.max("src_len") + F.max("tgt_len")).alias("width")
    )
    return _stats(each)


def _stats(each: DataFrame) -> DataFrame:
    return each.groupBy("split").agg(
        F.count("*").alias("batches"), F.max("n").alias("largest_batch"), F.sum("real").alias("real_tokens"), F.sum(F.col("n") * F.col("width")).alias("padded_tokens")
    )


def planned_stats(lengths: DataFrame, batch_size: int, max_tokens: int, gathered: int = GATHERED_CELLS) -> DataFrame:
    """``batch_stats`` of the batches that items of these lengths (split, src_len, tgt_len) make, from the cells alone: no item
    is numbered or moved."""
    cells = cells_of(lengths, batch_size, max_tokens, gathered)
    counted = lengths.groupBy("split", "src_len", "tgt_len").agg(F.count("*").alias("n"))
    rest = F.col("n") - F.col("room")
    whole = F.floor((rest + F.col("full") - 1) / F.col("full")).cast("long")
    joining = F.struct(F.col("batch").alias("batch_id"), F.col("room").alias("items"))
    begun = F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(whole, F.lit(1).cast("long"))), lambda k: F.struct((F.col("batch") + k).alias("batch_id"), F.least(F.col("full"), rest - (k - 1) * F.col("full")).alias("items")))
    parts = counted.join(cells, ["split", "src_len", "tgt_len"]).select("split", "src_len", "tgt_len", F.inline(F.concat(F.array(joining), F.when(whole > 0, begun).otherwise(F.array().cast("array<struct<batch_id:bigint,items:bigint>>")))))
    each = parts.where("items > 0").groupBy("split", "batch_id").agg(
        F.sum("items").alias("n"), F.sum(F.col("items") * (F.col("src_len") + F.col("tgt_len"))).alias("real"), (F.max("src_len") + F.max("tgt_len")).alias("width")
    )
    return _stats(each)


def epoch_key(seed: int, epoch: int) -> int:
    return seed ^ (epoch << 32)


def epoch_order(batched: DataFrame, seed: int, epoch: int, split: str = "train") -> DataFrame:
    """batch_id, place: a seeded order of a split's batches for one epoch; the batches themselves stay. A batch's place is
    computed from its number, by a permutation of as many numbers as there are batches."""
    most = batched.where(F.col("split") == split).agg(F.max("batch_id").alias("most")).first()["most"]
    n = 0 if most is None else most + 1
    return order_of(batched.sparkSession, n, seed, epoch)


def order_of(spark: SparkSession, n: int, seed: int, epoch: int) -> DataFrame:
    """``epoch_order`` of n batches."""
    numbers = spark.range(n).withColumnRenamed("id", "batch_id")
    return numbers.select("batch_id", permute(F.col("batch_id"), n, epoch_key(seed, epoch)).alias("place"))


def batch_at(place: int, n: int, seed: int, epoch: int) -> int:
    """Which of a split's n batches an epoch has at a place."""
    return int(restored(np.array([place]), n, epoch_key(seed, epoch))[0])


def get_batch(batched: DataFrame, split: str, batch_id: int) -> DataFrame:
    """One batch as a row: its items in order."""
    own = batched.where((F.col("split") == split) & (F.col("batch_id") == batch_id))
    fields = [c for c in batched.columns if c not in ("split", "batch_id", "pos_in_batch")]
    return own.groupBy("split", "batch_id").agg(F.array_sort(F.collect_list(F.struct("pos_in_batch", *fields))).alias("items"))
