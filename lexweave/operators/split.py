"""Leak-free splits: sentences linked by translation share one split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from lexweave.functions.hashing import fnv1a64, limbs_mod
from lexweave.functions.text import node_key, with_nfc
from lexweave.operators.graph import connected_components
from lexweave.operators.indexing import dense_index
from lexweave.plans.session import stored

TRAIN, VALID, TEST = "train", "valid", "test"
BUCKETS = 1000
#: Salts that node numbers are tried with; a second one is needed once in 10,000 times at 60 million keys.
SALTS = 8
#: Bytes at the beginning of a key by which a component's keys are compared first.
HEAD = 16


@dataclass(frozen=True)
class SplitConfig:
    """Shares of components in thousandths; the test range comes first."""

    test_per_mille: int = 10
    valid_per_mille: int = 10


def split_of(bucket: Column, config: SplitConfig = SplitConfig()) -> Column:
    """Split of a hash modulo 1000."""
    return (
        F.when(bucket < config.test_per_mille, TEST).when(bucket < config.test_per_mille + config.valid_per_mille, VALID).otherwise(TRAIN)
    )


def with_keys(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the nodes that each joins: a (source) and b (target)."""
    plain = pairs.select("*", F.col("src").alias("__s"), F.col("tgt").alias("__t"))
    normal = with_nfc(plain, "__s", "__t")
    return normal.select(*pairs.columns, node_key(F.col("src_lang"), F.col("__s")).alias("a"), node_key(F.col("tgt_lang"), F.col("__t")).alias("b"))


def _digest(c: str) -> Column:
    return F.unhex(F.md5(F.col(c).cast("binary")))


def nodes(keyed: DataFrame) -> DataFrame:
    """Distinct keys."""
    return keyed.select(F.explode(F.array("a", "b")).alias("key")).distinct()


def _named(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``keyed`` with the nodes' numbers a_id and b_id, and the edges' components (node, component).

    Keys are told apart by digests of 128 bits; a node's number is a hash of its digest with the first salt under which no two
    digests have the same one. So no key is exchanged for the graph rounds.
    """
    names = keyed.select(F.explode(F.array("a_name", "b_name")).alias("name"))
    for salt in range(SALTS):
        number = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(F.col(c), F.lit(salt)))  # noqa: B023, E731
        met = names.select("name", number("name").alias("id")).groupBy("id").agg(F.min("name").alias("low"), F.max("name").alias("high"))
        if met.where("low <> high").isEmpty():
            numbered = keyed.withColumns({"a_id": number("a_name"), "b_id": number("b_name")})
            return numbered, connected_components(numbered, "a_id", "b_id", lone_apart=True)
    raise RuntimeError(f"no numbers for the keys under {SALTS} salts")


def grouped(pairs: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (the ``keep`` columns of ``pairs``, all of them by default, a, b, a_id), roots (a_id, root) and components (root,
    least: the smallest key of the component, bytewise, and pairs, their number)."""
    whole = pairs.where("src_lang is not null and src is not null")  # a row without a source is in no component
    keyed = with_keys(whole).select(*(pairs.columns if keep is None else keep), "a", "b", _digest("a").alias("a_name"), _digest("b").alias("b_name"))
    keyed, found = _named(stored(keyed))
    own = keyed.groupBy("a_id").agg(F.min(F.least("a", "b")).alias("low"), F.count("*").alias("n"))
    own = stored(own.join(found, F.col("a_id") == F.col("node"), "left").select("a_id", F.coalesce("component", "a_id").alias("root"), "low", "n"))
    heads = stored(own.groupBy("root").agg(F.min("low").alias("least"), F.sum("n").alias("pairs")))
    return keyed, own.select("a_id", "root"), heads


def bucketed(pairs: DataFrame, keep: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (the ``keep`` columns, a_id), roots (a_id, root) and components (root, bucket: that of the smallest key, and pairs),
    as ``grouped`` has them, but no key is exchanged: of a component's keys only the first HEAD bytes and the buckets
    meet. The bucket is known where all keys with the least beginning have the same one; elsewhere the whole keys
    with that beginning, and no others, decide."""
    whole = pairs.where("src_lang is not null and src is not null")  # a row without a source is in no component
    keyed = with_keys(whole).select(*keep, _digest("a").alias("a_name"), _digest("b").alias("b_name"), F.least("a", "b").alias("low"))
    keyed = keyed.withColumns({"head": F.substring(F.col("low").cast("binary"), 1, HEAD), "bucket": limbs_mod(fnv1a64(F.col("low")), BUCKETS).cast("int")})
    keyed, found = _named(stored(keyed))
    ends = [F.min(F.struct("head", b.alias("bucket"))).alias(name) for name, b in (("least", F.col("bucket")), ("most", -F.col("bucket")))]
    own = keyed.groupBy("a_id").agg(*ends, F.count("*").alias("n"))
    own = stored(own.join(found, F.col("a_id") == F.col("node"), "left").select("a_id", F.coalesce("component", "a_id").alias("root"), "least", "most", "n"))
    heads = own.groupBy("root").agg(F.min("least").alias("least"), F.min("most").alias("most"), F.sum("n").alias("pairs"))
    heads = stored(heads.select("root", "least.head", "least.bucket", (F.col("least.bucket") + F.col("most.bucket") != 0).alias("open"), "pairs"))
    rows, roots, known = keyed.select(*keep, "a_id"), own.select("a_id", "root"), heads.select("root", "bucket", "pairs")
    if heads.where("open").isEmpty():
        return rows, roots, known
    begun = own.select("a_id", "root", F.col("least.head").alias("head")).join(heads.where("open").select("root", "head"), ["root", "head"])
    met = keyed.select("a_id", "head", "low", "bucket").join(stored(begun), ["a_id", "head"])  # few rows: Spark broadcasts them
    decided = met.groupBy("root").agg(F.min(F.struct("low", "bucket"))["bucket"].alias("decided"))
    return rows, roots, known.join(decided, "root", "left").select("root", F.coalesce("decided", "bucket").alias("bucket"), "pairs")


def place_splits(pairs: DataFrame, config: SplitConfig, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of ``pairs`` with split, as ``assign_splits`` gives it."""
    rows, roots, heads = bucketed(pairs, keep)
    named = heads.select("root", split_of(F.col("bucket"), config).alias("split"))
    return rows.join(roots.join(named, "root"), "a_id").select(*keep, "split")


def with_split(heads: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """``heads`` of ``grouped`` with the split of each component."""
    return heads.withColumn("split", split_of(limbs_mod(fnv1a64(F.col("least")), BUCKETS), config))


def assign_splits(pairs: DataFrame, config: SplitConfig = SplitConfig(), number: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``pairs`` (or their ``keep`` columns) with a, b, least (smallest key of the pair's component) and split; with ``number``
    also component, dense from 0 by the component's first ``ord``. The split doesn't depend on the order of rows."""
    keyed, roots, heads = grouped(pairs, keep)
    columns = [*(pairs.columns if keep is None else keep), "a", "b", "least", "split"]
    named = with_split(heads, config).select("root", "least", "split")
    if number:
        first = keyed.groupBy("a_id").agg(F.min("ord").alias("ord")).join(roots, "a_id").groupBy("root").agg(F.min("ord").alias("first"))
        named = named.join(dense_index(first, ["first"], "component").select("root", "component"), "root")
        columns.append("component")
    return keyed.join(roots.join(named, "root"), "a_id").select(*columns)


def split_counts(pairs: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """``split_summary`` of the splits of ``pairs``, from their components alone: no pair is moved again."""
    heads = bucketed(pairs, keep=[])[2].withColumn("split", split_of(F.col("bucket"), config))
    return heads.groupBy("split").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("components"))


def split_summary(assigned: DataFrame) -> DataFrame:
    """split, pairs, components."""
    per_component = assigned.groupBy("split", "least").agg(F.count("*").alias("n"))
    return per_component.groupBy("split").agg(F.sum("n").alias("pairs"), F.count("*").alias("components"))
