"""SimHash near-dedup by a segment-popcount embedding.

A fingerprint of 64 bits becomes a point of 32 bit counts, one for each segment of two bits. The Manhattan distance
of two points is at most the Hamming distance of their fingerprints, so a grid range-join over the points loses no
pair: the coordinates are dealt into five blocks, a pair within three bits differs in three blocks at most, so it
shares a unit grid cell on at least one of the ten pairs of blocks. Members of a cell meet there, the Manhattan
distance is tested first, the Hamming distance last. A cell with many members is dealt into chunks, and pairs of
chunks go to different tasks. A task sends on a spanning forest of its links, never all pairs of a group.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import forest, read, release, unite, whole_cells, with_columns
from lexweave.operators.graph import connected_components
from lexweave.plans.session import cut

#: Members of a cell that one task compares with each other; more are dealt out in chunks of this size.
CHUNK = 8192
SEGMENTS, WIDTH = 32, 2
LOW = 0x5555555555555555


def fingerprint(raw: bytes | None, shingle: int) -> int:
    """The fingerprint of a text's words (lower-cased A-Z, split at ASCII white space)."""
    words = raw.lower().split() if raw else []
    if not words:
        return 0
    grams = words if shingle == 1 else [b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    digest = xxhash.xxh64_intdigest
    votes, step = np.zeros(64, dtype=np.int64), 1 << 16
    for start in range(0, len(grams), step):  # a very long text's bits are counted piece by piece
        part = grams[start : start + step]
        h = np.fromiter((digest(g, 42) for g in part), dtype="<u8", count=len(part))
        votes += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(grams), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed BIGINT)."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(raw.as_py(), shingle) for raw in batch.column("raw")], dtype=np.uint64)
            release()
            yield with_columns(batch, ["doc_id"], fp=pa.array(fp.view(np.int64)))

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("raw"))
    return source.mapInArrow(run, "doc_id long, fp long")


def block_masks(bits: int) -> list[int]:
    """Masks of the coordinate subsets: the segments in bits + 2 blocks, each pair of blocks a subset."""
    blocks = np.array_split(np.arange(SEGMENTS), bits + 2)
    masks = [sum(0b11 << (WIDTH * int(s)) for s in block) for block in blocks]
    return [a | b for a, b in itertools.combinations(masks, 2)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def embedded(fp):
    """The 32 bit counts of a fingerprint column in one BIGINT, each count as 00, 01 or 11: the Manhattan
    distance of two points is the number of differing bits."""
    high = F.shiftrightunsigned(fp, 1)
    some, both = fp.bitwiseOR(high).bitwiseAND(F.lit(LOW)), fp.bitwiseAND(high).bitwiseAND(F.lit(LOW))
    return some.bitwiseOR(F.shiftleft(both, 1))


def linked_in_cells(cell: np.ndarray, fp: np.ndarray, point: np.ndarray, bits: int) -> np.ndarray:
    """Parent array of the rows' forest; rows are sorted by cell."""
    n = len(cell)
    parent = np.arange(n)
    starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    sizes = np.diff(np.concatenate([starts, [n]]))

    def meet(a, b):
        near = np.bitwise_count(point[a] ^ point[b]) <= bits
        a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= bits
        if near.any():
            unite(parent, a[near], b[near])

    small = np.repeat(sizes <= 64, sizes)
    at = np.flatnonzero(small)
    for d in range(1, 64):  # all pairs of small cells, by their distance in the sorted order
        at = at[at + d < n]
        at = at[cell[at] == cell[at + d]]
        if not len(at):
            break
        meet(at, at + d)
    for s, m in zip(starts[sizes > 64].tolist(), sizes[sizes > 64].tolist(), strict=True):
        f, p = fp[s : s + m], point[s : s + m]
        for i in range(0, m, 256):
            rows = p[i : i + 256, None]
            near = np.bitwise_count(rows ^ p[None, i:]) <= bits
            a, b = np.nonzero(near)
            ok = (b > a) & (np.bitwise_count(f[i : i + 256][a] ^ f[i:][b]) <= bits)
            if ok.any():
                unite(parent, a[ok] + (s + i), b[ok] + (s + i))
    return parent


def links(classes: DataFrame, bits: int = 3, chunk: int = CHUNK) -> DataFrame:
    """Edges (a, b) between class representatives whose connected components are those of all pairs within
    ``bits``. ``classes``: rep, fp, one row for each distinct fingerprint."""
    masks = block_masks(bits)
    subset = F.posexplode(F.array(*[F.lit(signed(m)) for m in masks])).alias("subset", "mask")
    cells = (
        classes.withColumn("point", embedded(F.col("fp")))
        .select("rep", "fp", "point", subset)
        .select("rep", "fp", "point", "subset", F.col("point").bitwiseAND(F.col("mask")).alias("cell"))
    )
    crowded = (
        cells.groupBy("subset", "cell").count().where(F.col("count") > chunk)
        .select("subset", "cell", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))
    )
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = (
        cells.join(crowded, ["subset", "cell"], "left")
        .withColumn("own", F.when(F.col("chunks").isNull(), F.lit(0)).otherwise(own))
        .withColumn("other", other)
        .select("rep", "fp", "point", F.xxhash64("subset", "cell", F.least("own", "other"), F.greatest("own", "other")).alias("at"))
    )

    def run(batches):
        for rows in whole_cells(batches, "at"):  # a cell has two chunks at most
            rep, fp, point, at = (rows[c].to_numpy() for c in ("rep", "fp", "point", "at"))
            node, root = forest(linked_in_cells(at, fp.view(np.uint64), point.view(np.uint64), bits))
            yield pd.DataFrame({"a": rep[node], "b": rep[root]})

    return dealt.repartition("at").sortWithinPartitions("at").mapInPandas(run, "a long, b long")


def simhash_groups(docs: DataFrame, shingle: int = 3, bits: int = 3, chunk: int = CHUNK) -> DataFrame:
    """One row for each document: doc_id, fp, component_id.

    Documents whose fingerprints differ in at most ``bits`` bits are linked; component_id is the smallest doc_id
    that links reach, the document itself included. A text without words (null, empty, white space) has the
    fingerprint zero and is linked like any other. Rows with equal doc_ids are each returned; a null doc_id gives
    its group no name of its own: it links others as any row does and gets its component, null if that holds no id. Other
    columns of ``docs`` are not read.
    """
    prints = cut(fingerprints(docs, shingle))
    # a fingerprint is its class's node: one that only rows without an id have links others all the same
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    named = connected_components(links(classes.select("fp", F.col("fp").alias("rep")), bits, chunk), "a", "b")
    linked = classes.join(named, F.col("fp") == F.col("node"))
    lows = linked.groupBy("component").agg(F.min("low").alias("least"))
    members = linked.select("fp", "component").join(lows, "component").select(F.col("fp").alias("__fp"), "least")
    # written, so that the join with all documents is between two plain exchanges, which are split where copies crowd
    labels = classes.join(members, F.col("fp") == F.col("__fp"), "left").select("fp", F.when(F.col("__fp").isNull(), F.col("low")).otherwise(F.col("least")).alias("component_id"))
    return prints.join(cut(labels), "fp", "left").select("doc_id", "fp", "component_id")


def simhash_dedup(docs: DataFrame, shingle: int = 3, bits: int = 3) -> DataFrame:
    """The documents that stay: of each group the one with the smallest doc_id, with all its columns. Rows that share
    a doc_id are one document and one of them stays, the first by text; rows with a null doc_id have no identity to
    be a copy under, so all of them stay."""
    return keep_first(docs, simhash_groups(docs, shingle, bits))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``simhash_dedup`` keeps, for ``groups`` (doc_id, component_id)."""
    stay = groups.where("doc_id = component_id").groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__n"))
    once, often = (docs.join(stay.where(c), F.col("doc_id") == F.col("__id")) for c in ("__n = 1", "__n > 1"))
    first = F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNotNull(), F.coalesce("text", F.lit(""))))  # partial sums: no hot id
    one = often.groupBy("__id").agg(first.alias("__row")).select("__row.*")
    return once.select(*docs.columns).unionByName(one.select(*docs.columns)).unionByName(docs.where("doc_id is null"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash_groups(read(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
