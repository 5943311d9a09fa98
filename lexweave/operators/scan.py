"""Running sums over rows of any number, with a group spread over as many tasks as its rows need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.operators.indexing import PLACE_BITS
from lexweave.plans.session import cut, shuffle_partitions


def running_sums(df: DataFrame, order: list[str], sums: dict[str, Column], within: list[str] | None = None) -> DataFrame:
    """``df`` with the sums of the columns over all rows up to and with each one in the order, restarting for each value of the
    ``within`` columns; the order is total inside them. Nulls add nothing; where only nulls were, the sum is null.

    Two levels: rows are dealt by ranges of the order and sorted once; each range's sums are aggregated, and what earlier
    ranges of a group hold is a window over one row for each range and group; the rows of a range are then gone over
    by themselves.
    """
    within = within or []
    keys = [*within, *order]
    dealt = df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.withColumns({"__part": F.shiftright(F.monotonically_increasing_id(), PLACE_BITS).cast("int"), **{f"__add_{name}": c for name, c in sums.items()}}))
    held = dealt.groupBy("__part", *within).agg(*[F.sum(f"__add_{name}").alias(f"__own_{name}") for name in sums])
    earlier = Window.partitionBy(*within).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = held.select("__part", *within, *[F.sum(f"__own_{name}").over(earlier).alias(f"__before_{name}") for name in sums])
    so_far = Window.partitionBy("__part", *within).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.select("__part", *df.columns, *[F.sum(f"__add_{name}").over(so_far).alias(f"__in_{name}") for name in sums]).alias("rows")
    met = inside.join(before.alias("before"), [F.expr(f"rows.`{c}` <=> before.`{c}`") for c in ("__part", *within)])
    total = lambda name: F.when(F.col(f"__in_{name}").isNull(), F.col(f"__before_{name}")).otherwise(F.col(f"__in_{name}") + F.coalesce(f"__before_{name}", F.lit(0)))
    return met.select(*[F.col(f"rows.`{c}`") for c in df.columns], *[total(name).alias(name) for name in sums])
