"""Strict JSON-lines reader for sentence pairs, and the writers of artifacts."""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator, Mapping
from dataclasses import asdict, is_dataclass
from decimal import Decimal
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from lexweave.functions.text import is_blank
from lexweave.functions.tokens import LANGUAGES

SEG_MAX = 18446744073709551615
PAIR = T.StructType([
    T.StructField("ord", T.LongType(), False),
    T.StructField("id", T.StringType(), False),
    T.StructField("src_lang", T.StringType(), False),
    T.StructField("tgt_lang", T.StringType(), False),
    T.StructField("src", T.StringType(), False),
    T.StructField("tgt", T.StringType(), False),
    T.StructField("corpus", T.StringType(), False),
    T.StructField("doc", T.StringType(), True),
    T.StructField("seg", T.DecimalType(20, 0), True),
])
TEXTS = ("id", "src_lang", "tgt_lang", "src", "tgt", "corpus")


def _field(v: Column, name: str) -> Column:
    return F.try_variant_get(v, f"$.{name}", "variant")


def _kind(v: Column, name: str) -> Column:
    """Type of a field: null if it is missing, VOID for a JSON null."""
    return F.schema_of_variant(_field(v, name))


def _fault(v: Column, languages: Iterable[str]) -> Column:
    """What is wrong with a parsed line; null if nothing is."""
    out = F.lit(None).cast("string")
    seg, kind = F.try_variant_get(v, "$.seg", "decimal(38,0)"), _kind(v, "seg")
    seg_ok = kind.isNull() | (kind == "VOID") | (kind.rlike(r"^(BIGINT|DECIMAL\(\d+,0\))$") & seg.between(0, F.lit(str(SEG_MAX)).cast("decimal(20,0)")))
    out = F.when(~seg_ok, "seg: expected an unsigned 64-bit number").otherwise(out)
    doc = _kind(v, "doc")
    out = F.when(~(doc.isNull() | doc.isin("VOID", "STRING")), "doc: expected a string").otherwise(out)
    for name in ("src_lang", "tgt_lang"):
        known = F.try_variant_get(v, f"$.{name}", "string").isin(*languages)
        out = F.when(~F.coalesce(known, F.lit(False)), f"{name}: unknown language").otherwise(out)
    for name in reversed(TEXTS):
        kind = _kind(v, name)
        out = F.when(kind.isNull(), f"{name}: missing field").when(kind != "STRING", f"{name}: expected a string").otherwise(out)
    return F.when(v.isNull(), "malformed JSON or a repeated key").when(~F.schema_of_variant(v).startswith("OBJECT"), "expected an object").otherwise(out)


def parse_pairs(lines: DataFrame, languages: Iterable[str] = LANGUAGES) -> DataFrame:
    """Pairs from rows (place, value). A line that isn't a pair fails the query with ``place: reason``; unknown fields
    are ignored, blank lines are the caller's."""
    once = lambda c: F.explode(F.array(c))  # noqa: E731  (a filter isn't pushed below a generator, which would repeat what it is of)
    parsed = lines.select("*", once(F.try_parse_json("value")).alias("__v"))
    checked = parsed.select("*", once(_fault(F.col("__v"), tuple(languages))).alias("__fault"))
    ok = F.when(F.col("__fault").isNotNull(), F.raise_error(F.concat("place", F.lit(": "), "__fault"))).otherwise(F.lit(True))
    get = lambda name, kind: F.try_variant_get(F.col("__v"), f"$.{name}", kind)
    return checked.where(ok).select(
        *[c for c in lines.columns if c not in ("place", "value")],
        *[get(name, "string").alias(name) for name in TEXTS], get("doc", "string").alias("doc"), get("seg", "decimal(20,0)").alias("seg"),
    )


def _numbered(text: DataFrame) -> DataFrame:
    """file, line, ord, value of the lines that aren't blank: ``line`` from 0 in each file, all lines counted; ``ord`` from 0
    over all files. Rows (file, block, value) stand in file order inside their block, as a scan gives them.

    Lines aren't moved. One pass counts each block of a file (there are as many as the scan has splits), what stands before
    a block is summed over that list, and a second pass counts on from there inside each block.
    """
    marked = text.withColumn("full", ~is_blank(F.col("value")))
    counts = marked.groupBy("file", "block").agg(F.count("*").alias("lines"), F.count_if("full").alias("full")).orderBy("file", "block").collect()
    before, line, ord_, file = {}, 0, 0, None
    for r in counts:
        line = 0 if r["file"] != file else line
        file = r["file"]
        before[file, r["block"]] = line, ord_
        line, ord_ = line + r["lines"], ord_ + r["full"]
    shared = text.sparkSession.sparkContext.broadcast(before)

    def count_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, line, ord_ = None, 0, 0
        for batch in batches:
            full = batch.column("full").to_numpy(zero_copy_only=False)
            starts = batch.column("block").to_numpy()
            files = batch.column("file").dictionary_encode()
            codes = files.indices.to_numpy()
            heads = np.flatnonzero(np.concatenate([[True], (np.diff(starts) != 0) | (np.diff(codes) != 0)])) if len(starts) else []
            lines, ords = np.empty(len(starts), dtype=np.int64), np.empty(len(starts), dtype=np.int64)
            for a, b in zip(heads, [*heads[1:], len(starts)], strict=True):
                if (own := (files.dictionary[codes[a]].as_py(), int(starts[a]))) != block:
                    block, (line, ord_) = own, shared.value[own]
                lines[a:b] = line + np.arange(b - a)
                ords[a:b] = ord_ + np.cumsum(full[a:b]) - full[a:b]
                line, ord_ = line + int(b - a), ord_ + int(full[a:b].sum())
            kept = pa.array(full)
            out = [batch.column("file"), pa.array(lines), pa.array(ords), batch.column("value")]
            yield pa.RecordBatch.from_arrays([c.filter(kept) for c in out], ["file", "line", "ord", "value"])

    return marked.mapInArrow(count_on, "file string, line long, ord long, value string")


def read_pairs(spark: SparkSession, path: str, languages: Iterable[str] = LANGUAGES) -> DataFrame:
    """Pairs of JSON-lines files, with ``ord``: dense from 0 in file and line order, blank lines not counted. Errors name
    the file and the line, from 1, blank lines counted."""
    text = spark.read.option("lineSep", "\n").text(path).select(
        F.regexp_replace(F.col("value"), r"\r$", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
    )
    text = text.withColumn("value", F.when(F.is_valid_utf8("value"), F.col("value")).otherwise(F.raise_error(F.concat("file", F.lit(": invalid UTF-8")))))
    place = F.concat("file", F.lit(":"), (F.col("line") + 1).cast("string"))
    return parse_pairs(_numbered(text).select("ord", place.alias("place"), "value"), languages)


def pairs_from_rows(spark: SparkSession, rows: Iterable[Mapping[str, Any]]) -> DataFrame:
    """The in-memory source: dictionaries with at least src_lang, tgt_lang, src, tgt."""
    full = [
        (i, r.get("id", str(i)), r["src_lang"], r["tgt_lang"], r["src"], r["tgt"], r.get("corpus", "memory"), r.get("doc"), None if r.get("seg") is None else Decimal(r["seg"]))
        for i, r in enumerate(rows)
    ]
    return spark.createDataFrame(full, PAIR)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """JSON lines, in ``ord`` order; null fields are left out."""
    fields = [f.name for f in PAIR if f.name != "ord" and f.name in pairs.columns]
    pairs.orderBy("ord").select(F.to_json(F.struct(*fields)).alias("value")).write.mode("overwrite").text(path)


def write_vocabulary(vocabulary: DataFrame, path: str) -> None:
    """The token id of each compact id as one JSON array; at most 65,535 numbers."""
    row = vocabulary.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("compact_id", "token_id"))), lambda x: x["token_id"])).alias("value"))
    row.coalesce(1).write.mode("overwrite").text(path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    ids = spark.read.text(path, wholetext=True).where("trim(value) <> ''").select(F.from_json("value", "array<int>").alias("ids"))
    return ids.select(F.posexplode("ids").alias("compact_id", "token_id"))


def write_config(spark: SparkSession, config: Any, path: str) -> None:
    """A dataclass or dictionary as one JSON document, to any store that Spark writes."""
    body = json.dumps(asdict(config) if is_dataclass(config) else dict(config), sort_keys=True)
    spark.createDataFrame([(body,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_config(spark: SparkSession, path: str) -> dict:
    return json.loads("".join(r[0] for r in spark.read.text(path).collect()))
