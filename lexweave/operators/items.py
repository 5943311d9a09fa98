"""Directed examples from pairs, with the reasons why some are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lexweave.operators.indexing import dense_index

MAX_LENGTH = 128


def directed(pairs: DataFrame, both_directions: bool = True) -> DataFrame:
    """One row for each pair and direction: ord, split, dir (0 forward, 1 swapped), languages and ids as they stand in that
    direction, lengths as the model sees them (a tag and an end on the source side, an end on the target side)."""
    side = lambda d, s, t: F.struct(
        F.lit(d).alias("dir"), F.col(f"{s}_lang").alias("src_lang"), F.col(f"{t}_lang").alias("tgt_lang"), F.col(f"{s}_ids").alias("src_ids"), F.col(f"{t}_ids").alias("tgt_ids")
    )
    ways = F.array(side(0, "src", "tgt"), *[side(1, "tgt", "src")] * both_directions)
    return pairs.select("ord", "split", F.inline(ways)).withColumns({"src_len": F.size("src_ids") + 2, "tgt_len": F.size("tgt_ids") + 1})


def with_lengths(sizes: DataFrame, both_directions: bool = True) -> DataFrame:
    """``directed`` without ids, from the numbers of tokens src_n and tgt_n: rows of a few bytes, whatever the texts' size. Without
    ord where the sizes have none."""
    side = lambda d, s, t: F.struct(
        F.lit(d).alias("dir"), F.col(f"{s}_lang").alias("src_lang"), F.col(f"{t}_lang").alias("tgt_lang"), (F.col(f"{s}_n") + 2).alias("src_len"), (F.col(f"{t}_n") + 1).alias("tgt_len")
    )
    ways = F.array(side(0, "src", "tgt"), *[side(1, "tgt", "src")] * both_directions)
    return sizes.select(*[c for c in ("ord", "split") if c in sizes.columns], F.inline(ways))


def with_reason(ways: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """``dropped``: empty, too_long or null. An empty side is told first; either side may be too long."""
    empty = (F.col("src_len") == 2) | (F.col("tgt_len") == 1)
    long = (F.col("src_len") > max_length) | (F.col("tgt_len") > max_length)
    return ways.withColumn("dropped", F.when(empty, "empty").when(long, "too_long"))


def number(ways: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    """The kept rows of ``directed`` or ``with_lengths`` with ``item_idx``: dense from 0 inside each split, in pair order, forward
    before swapped."""
    kept = with_reason(ways, max_length).where("dropped is null").drop("dropped")
    return dense_index(kept, ["ord", "dir"], "item_idx", within=["split"])


def build_items(pairs: DataFrame, max_length: int = MAX_LENGTH, both_directions: bool = True, splits: list[str] | None = None) -> DataFrame:
    """The kept examples with ``item_idx``, as ``number`` gives it."""
    chosen = pairs.where(F.col("split").isin(splits)) if splits is not None else pairs
    return number(directed(chosen, both_directions), max_length)


def with_ids(rows: DataFrame, coded: DataFrame) -> DataFrame:
    """``rows`` (ord, dir, ...) with the ids of their direction, from ``coded`` (ord, src_ids, tgt_ids)."""
    met = rows.join(coded.select("ord", "src_ids", "tgt_ids"), "ord")
    swapped = lambda a, b: F.when(F.col("dir") == 0, F.col(a)).otherwise(F.col(b)).alias(a)
    return met.select(*rows.columns, swapped("src_ids", "tgt_ids"), swapped("tgt_ids", "src_ids"))


def build_stats(pairs: DataFrame, max_length: int = MAX_LENGTH, both_directions: bool = True) -> DataFrame:
    """split, pairs_in_split, items, dropped_too_long, dropped_empty; examples are counted by direction."""
    return stats_of(directed(pairs, both_directions), max_length)


def stats_of(ways: DataFrame, max_length: int = MAX_LENGTH) -> DataFrame:
    return with_reason(ways, max_length).groupBy("split").agg(
        F.count_if(F.col("dir") == 0).alias("pairs_in_split"), F.count_if(F.col("dropped").isNull()).alias("items"),
        F.count_if(F.col("dropped") == "too_long").alias("dropped_too_long"), F.count_if(F.col("dropped") == "empty").alias("dropped_empty"),
    )


def get_item(items: DataFrame, split: str, index: int) -> DataFrame:
    """The row of one index; none beyond the end."""
    return items.where((F.col("split") == split) & (F.col("item_idx") == index))
