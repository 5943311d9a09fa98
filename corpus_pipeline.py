"""From raw documents to tokens: each stage calls one operator, and what it decides is what the next one gets.

A stage is a function of (spark, docs, sf_dir); its rows are written as Parquet and read again as the next one's docs.
All but the last return the columns of ``documents`` and read no other; an empty table gives an empty one. A null doc_id
names no document: its row goes through every stage that keeps its text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm import bpe, decontaminate, language, near_copies, substring
from lexweave.llm._common import read
from lexweave.plans.session import ensure_checkpoint_dir, remove

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can't be told (a null or empty text, or no letters at all) go; a missing lang is filled in.
    Repeated rows stay as often as they are there."""
    model = language.learn(docs)
    known = language.identify(docs, model, keep=COLUMNS[1:]).where("lang_pred <> 'und'")
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more) stays, the one
    with the least id. Texts without words (null, empty) are copies of each other; rows that share an id are one
    document, the first by text; rows without an id all stay."""
    return near_copies.near_copy_dedup(docs).select(*COLUMNS)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document with a smaller id has are cut out; a document that loses every word goes, one that never
    had any (a null or empty text) stays. Repeated rows lose nothing to each other, rows without an id nothing at all."""
    out = substring.substring_dedup(docs, keep=["lang", "source"]).where("n_removed = 0 or n_removed < n_words")
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a benchmark item covers in one word of twenty or more go. A null or empty text is clean; repeated
    rows are judged alike."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"), keep=COLUMNS[1:]).where("not contaminated").select(*COLUMNS)


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with their number and digests; a null or empty text has none. A row for each row."""
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("substring_dedup", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("bpe", to_tokens),
]

#: The mixture inference of the first stage and the token ids of the last are no SQL; tests hold each stage's decisions on the
#: small tables against a plain version: letters, all pairs, all windows, all items, the tokenizers library.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows go to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    base = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}"
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        out.write.parquet(f"{base}/{k}_{name}")
        docs = spark.read.parquet(f"{base}/{k}_{name}")
        if k:  # the rows before these are read no more
            remove(spark, f"{base}/{k - 1}_{STAGES[k - 1][0]}")
    return docs
