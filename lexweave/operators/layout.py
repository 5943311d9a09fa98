"""Padded, shifted and masked rows of a batch."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.operators.vocabulary import COMPACT_BOS, COMPACT_EOS, COMPACT_PAD, compact_tag


MATRICES = "src array<bigint>, tgt_in array<bigint>, tgt_out array<bigint>"


def _padded(row: Column, width: Column) -> Column:
    long = F.transform(row, lambda x: x.cast("long"))
    return F.concat(long, F.array_repeat(F.lit(COMPACT_PAD).cast("long"), width - F.size(row)))


def pad_batches(batched: DataFrame) -> DataFrame:
    """One row for each item: split, batch_id, pos_in_batch, batch_size, batch_src_len, batch_tgt_len, src (the tag of the
    target language, ids, end), tgt_in (begin, ids) and tgt_out (ids, end), padded to the batch's longest. A batch holds
    batch_size items at most, so its window is small."""
    own = Window.partitionBy("split", "batch_id")
    wide = batched.withColumns({
        "batch_size": F.count("*").over(own), "batch_src_len": F.max("src_len").over(own), "batch_tgt_len": F.max("tgt_len").over(own),
    })
    one = lambda x: F.array(F.lit(x))
    return wide.select(
        "split", "batch_id", "pos_in_batch", "batch_size", "batch_src_len", "batch_tgt_len",
        _padded(F.concat(F.array(compact_tag(F.col("tgt_lang"))), "src_ids", one(COMPACT_EOS)), F.col("batch_src_len")).alias("src"),
        _padded(F.concat(one(COMPACT_BOS), "tgt_ids"), F.col("batch_tgt_len")).alias("tgt_in"),
        _padded(F.concat("tgt_ids", one(COMPACT_EOS)), F.col("batch_tgt_len")).alias("tgt_out"),
    )


def pad_mask(row: Column) -> Column:
    """True where a place is padding, to be ignored."""
    return F.transform(row, lambda x: x == COMPACT_PAD)


def with_masks(padded: DataFrame) -> DataFrame:
    """Adds src_pad_mask and tgt_pad_mask (of tgt_in)."""
    return padded.withColumns({"src_pad_mask": pad_mask(F.col("src")), "tgt_pad_mask": pad_mask(F.col("tgt_in"))})


def causal_mask(size: Column | int) -> Column:
    """size x size; true where a position would see a later one."""
    n = F.lit(size) if isinstance(size, int) else size
    places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.transform(places, lambda j: j > i))


def matrices(padded: DataFrame) -> DataFrame:
    """One row for each batch: row-major flat src, tgt_in and tgt_out with their dimensions."""
    rows = padded.groupBy("split", "batch_id", "batch_size", "batch_src_len", "batch_tgt_len").agg(
        F.array_sort(F.collect_list(F.struct("pos_in_batch", "src", "tgt_in", "tgt_out"))).alias("rows")
    )
    return rows.select(
        "split", "batch_id", "batch_size", F.col("batch_src_len").alias("src_len"), F.col("batch_tgt_len").alias("tgt_len"),
        *[F.flatten(F.col(f"rows.{c}")).alias(c) for c in ("src", "tgt_in", "tgt_out")],
    )


def batch_matrices(batched: DataFrame) -> DataFrame:
    """``matrices`` of the batches: their unpadded rows meet once, and each batch's padding is made where it stands."""
    own = batched.groupBy("split", "batch_id").agg(
        F.count("*").alias("batch_size"), F.max("src_len").alias("src_len"), F.max("tgt_len").alias("tgt_len"),
        F.array_sort(F.collect_list(F.struct("pos_in_batch", compact_tag(F.col("tgt_lang")).alias("tag"), "src_ids", "tgt_ids"))).alias("rows"),
    )

    @F.arrow_udf(MATRICES)
    def run(size: pa.Array, src_len: pa.Array, tgt_len: pa.Array, rows: pa.Array) -> pa.Array:
        each, flat, tags = rows.value_lengths().to_numpy(), {}, rows.flatten().field("tag").to_numpy()
        widths = {"src": np.repeat(src_len.to_numpy(), each), "tgt_in": np.repeat(tgt_len.to_numpy(), each), "tgt_out": np.repeat(tgt_len.to_numpy(), each)}
        n = np.append(0, np.cumsum(each))
        for name, column in (("src", "src_ids"), ("tgt_in", "tgt_ids"), ("tgt_out", "tgt_ids")):
            ids, width = rows.flatten().field(column), widths[name]
            start, count = np.cumsum(width) - width, ids.value_lengths().to_numpy()
            out = np.full(int(width.sum()), COMPACT_PAD, dtype=np.int64)
            first = np.cumsum(count) - count
            at = np.repeat(start + (name != "tgt_out") - first, count) + np.arange(int(count.sum()))
            out[at] = ids.flatten().to_numpy()
            if name == "src":
                out[start] = tags
            if name == "tgt_in":
                out[start] = COMPACT_BOS
            else:
                out[start + count + (name == "src")] = COMPACT_EOS
            flat[name] = pa.ListArray.from_arrays(pa.array(np.append(start, len(out))[n], pa.int32()), pa.array(out))
        return pa.StructArray.from_arrays(list(flat.values()), names=list(flat))

    made = own.withColumn("made", run("batch_size", "src_len", "tgt_len", "rows"))
    return made.select("split", "batch_id", "batch_size", "src_len", "tgt_len", "made.src", "made.tgt_in", "made.tgt_out")


def to_numpy(row) -> dict[str, np.ndarray]:
    """The integer matrices of a row of ``matrices``, with their padding masks."""
    shape = {"src": row["src_len"], "tgt_in": row["tgt_len"], "tgt_out": row["tgt_len"]}
    if not row["batch_size"]:
        raise ValueError("a batch needs items")
    out = {k: np.array(row[k], dtype=np.int64).reshape(row["batch_size"], n) for k, n in shape.items()}
    return out | {"src_pad_mask": out["src"] == COMPACT_PAD, "tgt_pad_mask": out["tgt_in"] == COMPACT_PAD}
