"""Pair records and logits from general tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.operators.indexing import dense_index

#: Languages of the tables in the closed set of the pair records.
LANGUAGE_OF = {"en": "en", "de": "zh_Hans", "es": "pt_BR", "fr": "pt_BR"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_pairs(spark: SparkSession, sf_dir: str, numbered: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """ord, src_lang, tgt_lang, src, tgt: lines 2k and 2k + 1 of each document, without a window or a join; without ord, and
    its sort, if they aren't to be numbered, but with the columns ``keep`` (doc_id and p, the line of src, give the order)."""
    docs = table(spark, sf_dir, "documents").where("text is not null and lang is not null")
    docs = docs.select("doc_id", "lang", F.split("text", "\n").alias("lines"))  # a column of its own: made once, not for each place
    lines = F.col("lines")
    last = F.floor(F.size(lines) / 2).cast("int") - 1
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    pairs = F.transform(places, lambda i: F.struct((2 * i).alias("p"), F.get(lines, 2 * i).alias("src"), F.get(lines, 2 * i + 1).alias("tgt")))
    src_lang = F.lit(None).cast("string")
    for name, known in LANGUAGE_OF.items():
        src_lang = F.when(F.col("lang") == name, known).otherwise(src_lang)
    rows = docs.select("doc_id", src_lang.alias("src_lang"), F.inline(pairs)).where("src_lang is not null")
    rows = rows.withColumn("tgt_lang", F.when(F.col("src_lang") == "en", "pt_BR").otherwise("en"))
    if not numbered:
        return rows.select(*keep, "src_lang", "tgt_lang", "src", "tgt")
    return dense_index(rows, ["doc_id", "p"], "ord").select("ord", "src_lang", "tgt_lang", "src", "tgt")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, src, tgt: a user's turn and the assistant's next one."""
    turns = table(spark, sf_dir, "conversations")
    user = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("src"))
    reply = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt"))
    return user.join(reply, ["conv_id", "turn"])


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, logits, target (0 is padding)."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("logits"), F.col("label").alias("target"))
