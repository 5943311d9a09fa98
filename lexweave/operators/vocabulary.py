"""A dense dictionary of the tokens that a corpus uses."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from lexweave.functions.tokens import BOS, EOS, FILE_IDS, LANGUAGE_TAGS, PAD

# The first compact ids.
COMPACT_PAD, COMPACT_BOS, COMPACT_EOS = 0, 1, 2
COMPACT_TAGS = {"en": 3, "pt_BR": 4, "zh_Hans": 5}
N_SPECIAL = 6
#: Ids in one of Spark's bitmaps.
BITMAP_IDS = 32_768
SPECIALS = [PAD, BOS, EOS, *LANGUAGE_TAGS.values()]


def compact_tag(lang: Column) -> Column:
    """A language's tag in the compact id space."""
    out = F.raise_error(F.concat(F.lit("unknown language "), lang)).cast("int")
    for name, tag in COMPACT_TAGS.items():
        out = F.when(lang == name, F.lit(tag)).otherwise(out)
    return out


def distinct_tokens(tokens: DataFrame, *arrays: str) -> DataFrame:
    """token_id: the distinct ids (0 to 65,535) of the array columns. Tasks set bits, so what they exchange is at most three
    bitmaps each, of 32,768 ids or the 0."""
    both = F.array_distinct(F.concat(*[F.coalesce(F.col(a), F.array().cast("array<int>")) for a in arrays]))
    return distinct_ids(tokens.select(F.explode(both).alias("token_id")))


def distinct_ids(tokens: DataFrame) -> DataFrame:
    """token_id: the distinct ones (0 to 65,535), by bitmaps as above."""
    ids = tokens.select(F.col("token_id").cast("bigint").alias("id")).where("id IS NOT NULL")
    place, bucket = F.bitmap_bit_position("id"), F.bitmap_bucket_number("id")
    maps = ids.select(bucket.alias("bucket"), place.alias("place")).groupBy("bucket").agg(F.bitmap_construct_agg("place").alias("bits"))
    bits = maps.select("bucket", "bits", F.explode(F.sequence(F.lit(0), F.lit(BITMAP_IDS - 1))).alias("place"))
    byte = F.conv(F.hex(F.substring("bits", F.floor(F.col("place") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.expr("(byte >> CAST(place % 8 AS INT)) & 1") == 1
    number = F.when(F.col("bucket") == 0, -F.col("place")).otherwise((F.col("bucket") - 1) * BITMAP_IDS + F.col("place") + 1)
    return bits.withColumn("byte", byte).where(is_set).select(number.cast("int").alias("token_id"))


def build_vocabulary(tokens: DataFrame, *arrays: str) -> DataFrame:
    """compact_id, token_id: the specials, then the corpus's tokens by ascending id. There are at most 65,535 ids, so one
    window numbers them. A special inside a text fails the query."""
    return vocabulary_of(distinct_tokens(tokens, *arrays))


def vocabulary_of(used: DataFrame) -> DataFrame:
    """``build_vocabulary`` from the distinct ids (token_id)."""
    spark = used.sparkSession
    used = used.withColumn("token_id", F.when((F.col("token_id") == 0) | (F.col("token_id") >= FILE_IDS), F.raise_error(F.concat(F.lit("special token in a text: "), F.col("token_id").cast("string")))).otherwise(F.col("token_id")))
    regular = used.select((F.row_number().over(Window.orderBy("token_id")) + N_SPECIAL - 1).cast("int").alias("compact_id"), F.col("token_id").cast("int").alias("token_id"))
    special = spark.createDataFrame(list(enumerate(SPECIALS)), "compact_id int, token_id int")
    return special.unionByName(regular)


class Dictionary:
    """The two-way table on the driver (at most 65,535 rows) as columns."""

    def __init__(self, vocabulary: DataFrame):
        rows = sorted((r["compact_id"], r["token_id"]) for r in vocabulary.collect())
        if len(rows) > FILE_IDS + N_SPECIAL:
            raise ValueError(f"{len(rows)} ids in a vocabulary of at most {FILE_IDS + N_SPECIAL}")
        self.tokens = [t for _, t in rows]
        self._to = [-1] * (1 << 16)
        for compact, token in rows:
            self._to[token] = compact

    def __len__(self) -> int:
        return len(self.tokens)

    @staticmethod
    def _array(numbers: list[int]) -> Column:
        """An array literal: one string, which the optimizer folds once."""
        return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<int>")

    def encode(self, ids: Column) -> Column:
        """Compact ids; a token that the vocabulary doesn't have fails the query. Arrow batches are looked up in a table of
        65,536 numbers, right where a tokenizer's function has made their ids."""
        table = np.array(self._to, dtype=np.int32)

        @F.arrow_udf("array<int>")
        def run(lists: pa.Array) -> pa.Array:
            t = lists.flatten().fill_null(-1).to_numpy()
            fits = (t >= 0) & (t < len(table))
            found = np.where(fits, table[np.where(fits, t, 0)], -1)
            if len(bad := np.flatnonzero(found < 0)):
                raise ValueError(f"token outside of the vocabulary: {t[bad[0]]}")
            sizes = pc.list_value_length(lists).fill_null(0).to_numpy()
            nulls = np.append(lists.is_null().to_numpy(zero_copy_only=False), False)
            return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32(), mask=nulls), pa.array(found, pa.int32()))

        return run(ids)

    def decode(self, ids: Column) -> Column:
        return F.transform(ids, lambda c: F.element_at(self._array(self.tokens), c + 1))
