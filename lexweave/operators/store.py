"""Items and batches in a stored corpus that are read by number, without a scan.

Rows are dealt by (split, cluster), a cluster being a range of numbers, and sorted inside; a cluster is one file of small row
groups in a folder that its split and number name. A look-up states the split, the cluster and the number: the first two
prune folders when the plan is made, the last one row groups by their statistics.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from lexweave.plans.session import shuffle_partitions

#: Numbers of a cluster, and bytes of a row group.
PER_CLUSTER, ROW_GROUP = 1 << 16, 1 << 20


def write_clustered(rows: DataFrame, path: str, key: str, per: int = PER_CLUSTER, then: list[str] | None = None) -> None:
    """``rows`` (split, ``key`` from 0 on, ...) by clusters of ``per`` numbers, sorted by the key and the ``then`` columns."""
    cluster = F.floor(F.col(key) / per).cast("long")
    dealt = rows.withColumn("cluster", cluster).repartition(shuffle_partitions(rows.sparkSession), "split", "cluster")
    ordered = dealt.sortWithinPartitions("split", "cluster", key, *(then or []))
    ordered.write.option("parquet.block.size", ROW_GROUP).partitionBy("split", "cluster").parquet(path)


def read_clustered(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def at(stored: DataFrame, key: str, split: str, number: int, per: int = PER_CLUSTER) -> DataFrame:
    """The rows of one number; none beyond the end."""
    return stored.where((F.col("split") == split) & (F.col("cluster") == number // per) & (F.col(key) == number)).drop("cluster")


@F.arrow_udf(T.BinaryType())
def _packed(rows: pa.Array) -> pa.Array:
    """Each list's numbers as 32-bit little-endian integers, one after another; the lists' own buffers, not copied one by one."""
    lists = rows.cast(pa.large_list(pa.int32()))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values = lists.values.fill_null(0).to_numpy().astype("<i4")
    mask = np.append(lists.is_null().to_numpy(zero_copy_only=False), False)
    data = values[offsets[0] : offsets[-1]].tobytes()
    spans = pa.array((offsets - offsets[0]) * 4, pa.int64())
    whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lists), [None, spans.buffers()[1], pa.py_buffer(data)])
    return pa.compute.if_else(pa.array(mask[:-1]), pa.scalar(None, pa.large_binary()), whole).cast(pa.binary())


def tensors(batches: DataFrame) -> DataFrame:
    """``layout.matrices`` rows with src, tgt_in and tgt_out as the bytes of (batch_size, src_len or tgt_len) int32 matrices."""
    return batches.withColumns({c: _packed(F.col(c).cast("array<int>")) for c in ("src", "tgt_in", "tgt_out")})


def to_matrices(row) -> dict[str, np.ndarray]:
    """The matrices of a row of ``tensors``, views of its bytes."""
    width = {"src": row["src_len"], "tgt_in": row["tgt_len"], "tgt_out": row["tgt_len"]}
    return {k: np.frombuffer(row[k], dtype="<i4").reshape(row["batch_size"], n) for k, n in width.items()}


def write_tensors(batches: DataFrame, path: str, per: int = 64) -> None:
    """Tensor shards: a file for each ``per`` batches of a split, an epoch's batch being one row of one row group."""
    write_clustered(tensors(batches), path, "batch_id", per)
