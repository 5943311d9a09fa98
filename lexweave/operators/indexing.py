"""Dense row numbers over a total order, without a window over one partition."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.plans.session import shuffle_partitions, stored

#: ``monotonically_increasing_id`` has a row's place in its partition in so many bits, the partition above them.
PLACE_BITS = 33


def dense_index(df: DataFrame, order: list[str | Column], name: str, within: list[str] | None = None) -> DataFrame:
    """``df`` with ``name``, 0.. in the order given, restarting for each value of the ``within`` columns.

    Rows are dealt by ranges of the order and sorted once; a row's number is its place in its range and what earlier
    ranges hold, of which one count for each range is gathered. Values of ``within`` lie one after the other in that
    order, so their numbers begin at their least. A hot key is no hot partition: ranges are of rows.
    """
    within = within or []
    keys = [*within, *order]
    ranges = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = stored(ranges.withColumn("__row", F.monotonically_increasing_id()))
    part = F.shiftright("__row", PLACE_BITS).cast("int")
    held = {r["p"]: r["n"] for r in dealt.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}  # a row for each range
    before = [0, *accumulate(held.get(p, 0) for p in range(max(held, default=0) + 1))]
    shift = F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>")
    number = F.col("__row").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + F.get(shift, part)
    numbered = dealt.withColumn(name, number.cast("long")).drop("__row")
    if not within:
        return numbered
    first = numbered.groupBy(*within).agg(F.min(name).alias("__first"))
    joined = numbered.alias("rows").join(first.alias("first"), on=[F.expr(f"rows.`{c}` <=> first.`{c}`") for c in within])
    return joined.select(*[F.col(f"rows.`{c}`") for c in df.columns], (F.col(f"rows.`{name}`") - F.col("__first")).alias(name))
