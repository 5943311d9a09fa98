"""Pair lines as a stream. Only stateless steps: which split a pair belongs to depends on all pairs, also later ones, so
splits are assigned to tables, never to a stream."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lexweave.functions.text import is_blank, node_key
from lexweave.functions.tokens import LANGUAGES
from lexweave.sources.jsonl import parse_pairs


def stream_pairs(spark: SparkSession, path: str, languages: Iterable[str] = LANGUAGES) -> DataFrame:
    """Checked pairs of JSON-lines files as they arrive in a folder; a bad line fails the query and names its file."""
    lines = spark.readStream.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("place"))
    return parse_pairs(lines.where(~is_blank(F.col("value"))), languages)


def with_stream_keys(pairs: DataFrame) -> DataFrame:
    """Adds the nodes a and b; texts are taken to be in normal form C."""
    return pairs.withColumns({"a": node_key(F.col("src_lang"), F.col("src")), "b": node_key(F.col("tgt_lang"), F.col("tgt"))})


def ingest(pairs: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Everything there is, once, to Parquet under ``target``; a restart goes on where the last run ended."""
    return pairs.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
