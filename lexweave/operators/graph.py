"""Distributed connected components.

Alternating large-star and small-star rounds (Kiveris et al., "Connected Components in MapReduce and
Beyond", SoCC 2014) over BIGINT nodes. Each star is a partial aggregation (the minimum neighbour) and an
equi-join back, so a hub node is combined map-side and its join can be split by AQE; no node's
neighbours are ever gathered in one place. Rounds grow with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.plans.session import stored


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"),
    ).first()
    return (row["n"], row["h"])


def _two(*pairs) -> Column:
    """Two rows (u, v) from one: a generator in one pass, where a union would read the edges twice."""
    return F.inline(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs]))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(_two(("u", "v"), ("v", "u")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    low = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(low, "u").select(_two(("v", "m"), ("u", "m")))


def _with_lone(edges: DataFrame) -> DataFrame:
    """Distinct edges (u > v) with ``lone``: whether neither end has another neighbour."""
    both = edges.select(_two(("u", "v"), ("v", "u")))
    only = both.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).where("v = w")
    ends = only.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), F.lit(1).alias("end"))
    marks = edges.select("u", "v", F.lit(0).alias("end")).unionByName(ends)
    return marks.groupBy("u", "v").agg((F.sum("end") == 2).alias("lone"))


def connected_components(edges: DataFrame, src: str, dst: str, max_rounds: int = 100, lone_apart: bool = False) -> DataFrame:
    """Rows (node, component) for every node that has an edge to another one; component is the smallest
    reachable node. Null ends and loops are ignored; a graph without edges gives no rows. ``lone_apart``: edges that
    meet no other one are components from the start and take no part in the rounds (for graphs that mostly have such)."""
    e = (
        edges.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
        .select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where("u <> v")
        .distinct()
    )
    e = stored(_with_lone(e) if lone_apart else e)
    lone = e.where("lone").select("u", "v") if lone_apart else None
    if lone_apart:
        e = e.where("not lone").select("u", "v")
    before = _signature(e)
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        e = stored(_small_star(_large_star(e).where("u <> v").distinct()).where("u <> v").distinct())
        after = _signature(e)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = e.select(_two(("u", "v"), ("v", "v"))).distinct()
    if lone_apart:
        found = found.unionByName(lone.select(_two(("u", "v"), ("v", "v"))))
    return found.select(F.col("u").alias("node"), F.col("v").alias("component"))
