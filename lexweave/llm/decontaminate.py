"""Benchmark decontamination by winnowing.

With k-grams of 7 words and windows of 7 neighbouring k-grams, every shared span of 13 = 7 + 7 - 1 words keeps a
common fingerprint: the least k-gram hash of the window is the same on both sides. Test fingerprints are broadcast
in blocks of a bounded size (one block for a usual benchmark; a larger one goes over the documents once per block, one
block in memory at a time, and the blocks' hits are merged by text), documents' fingerprints meet them in the scan, and each hit is
extended to its 13 words and compared word by word. No document is shuffled.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import HashSet, covered, read, release, sliding_min, window_hashes, with_columns
from lexweave.plans.session import cut

#: Bytes of test text in one broadcast block; a larger benchmark is cut into more blocks.
BLOCK_BYTES = 8 << 20

#: Lower-cases A-Z and turns every byte that belongs to no word into a space.
TO_WORDS = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)


def words_of(raw: bytes | None) -> list[bytes]:
    return raw.translate(TO_WORDS).split() if raw else []


class Windows:
    """All test windows of one length, sorted by hash: one entry for each item that has one."""

    def __init__(self, flat: np.ndarray, h: np.ndarray, starts: np.ndarray, items: np.ndarray, size: int):
        order = np.lexsort((items, h))
        h, starts, items = h[order], starts[order], items[order]
        fresh = np.ones(len(h), dtype=bool)
        fresh[1:] = (h[1:] != h[:-1]) | (items[1:] != items[:-1])
        # another window with the hash of its neighbour keeps its own entry, whoever has it
        other = np.zeros(len(h), dtype=bool)
        for i in range(1, len(h), 1 << 16):
            j = min(i + (1 << 16), len(h))
            near = np.flatnonzero(h[i:j] == h[i - 1 : j - 1]) + i
            other[near] = (flat[starts[near][:, None] + np.arange(size)] != flat[starts[near - 1][:, None] + np.arange(size)]).any(axis=1)
        keep = fresh | other
        self.size, self.h, self.starts, self.items = size, h[keep], starts[keep], items[keep]
        self.known = HashSet(self.h)


class Index:
    """A block of test items: fingerprints for the join, the items' word numbers for the exact check. It takes about 40
    bytes for each word of the block."""

    def __init__(self, items: list[tuple[str, bytes]], length: int, gram: int):
        self.length, self.gram = length, gram
        self.number: dict[bytes, int] = {}
        self.names: list[str] = []
        sequences = []
        for name, raw in items:
            w = words_of(raw)
            if w:
                self.names.append(name)
                sequences.append(np.array([self.number.setdefault(x, len(self.number) + 1) for x in w], dtype=np.int32))
        rng = np.random.default_rng(20_240_501)
        self.salt = rng.integers(1, 1 << 63, size=len(self.number) + 1, dtype=np.uint64)
        self.flat = np.concatenate(sequences) if sequences else np.empty(0, dtype=np.int32)
        offset, by_size, prints = 0, {}, []
        for item, seq in enumerate(sequences):
            size = min(length, len(seq))
            h = window_hashes(self.salt[seq], size)
            parts = by_size.setdefault(size, ([], [], []))
            parts[0].append(h)
            parts[1].append(np.arange(offset, offset + len(h)))
            parts[2].append(np.full(len(h), item, dtype=np.int32))
            if len(seq) >= length:
                prints.append(sliding_min(window_hashes(self.salt[seq], gram), length - gram + 1))
            offset += len(seq)
        self.sizes = [Windows(self.flat, *(np.concatenate(p) for p in parts), size) for size, parts in by_size.items()]
        self.prints = HashSet(np.unique(np.concatenate(prints)) if prints else np.empty(0, dtype=np.uint64))

    def find(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are hit, and the items that have a window here."""
        n = len(words)
        hit, found = np.zeros(n, dtype=bool), set()
        get = self.number.get
        seq = np.fromiter((get(w, 0) for w in words), dtype=np.int32, count=n)
        h = self.salt[seq]
        for windows in self.sizes:
            size = windows.size
            if n < size:
                continue
            if size == self.length:
                least = sliding_min(window_hashes(h, self.gram), self.length - self.gram + 1)
                starts = np.flatnonzero(self.prints.has(least))
                if not len(starts):
                    continue
                own = window_hashes(h, size)[starts]
            else:
                starts, own = np.arange(n - size + 1), window_hashes(h, size)
            near = windows.known.has(own)
            if not near.any():
                continue
            starts, own = starts[near], own[near]
            first, run = np.unique(own, return_inverse=True)
            low, high = np.searchsorted(windows.h, first, "left"), np.searchsorted(windows.h, first, "right")
            good = np.zeros(len(starts), dtype=bool)
            step = 0
            while True:  # the entries of one hash, a step of all hashes at a time
                at = np.flatnonzero(low[run] + step < high[run])
                if not len(at):
                    break
                entry = low[run[at]] + step
                same = (seq[starts[at][:, None] + np.arange(size)] == self.flat[windows.starts[entry][:, None] + np.arange(size)]).all(axis=1)
                good[at[same]] = True
                found.update(windows.items[entry[same]].tolist())
                step += 1
            hit |= covered(starts[good], size, n)
        return hit, {self.names[i] for i in found}


def _blocks(items: DataFrame, block_bytes: int):
    """The test items in blocks of about ``block_bytes`` (a single longer item is a block), one at a time."""
    total = items.agg(F.sum(F.octet_length("t")).alias("b")).first()["b"] or 0
    parts = max(1, -(-int(total) // block_bytes))
    for p in range(parts):
        rows = items if parts == 1 else items.where(F.pmod(F.xxhash64("name", "t"), F.lit(parts)) == p)
        yield parts, [(r["name"], bytes(r["t"])) for r in rows.toLocalIterator()]


def decontaminate(docs: DataFrame, items: DataFrame, length: int = 13, gram: int = 7, block_bytes: int = BLOCK_BYTES, keep: list[str] | None = None) -> DataFrame:
    """Words of each whole document that a test item covers.

    ``docs``: doc_id, text; ``items``: item_id, text. A window is ``length`` consecutive words of an item, or all
    words of a shorter one; a document word in any occurrence of a window is hit. Returns doc_id, the ``keep``
    columns, n_words, n_hit, n_items, items (sorted item ids), contaminated (n_hit > 0 and at least one word in
    twenty). A null text has no words; a null item_id or text and an item without words have no windows; no items
    at all leave every document clean. Repeated rows and null doc_ids give a row each. Columns beside those named
    are not read. Of a benchmark over one block, one block at a time is in memory; texts with hits are written to the
    checkpoint folder, and their hits meet by the text's digest.
    """
    if not 0 < gram <= length:
        raise ValueError("gram must lie in 1..length")
    spark, keep = docs.sparkSession, keep or []
    named = items.select(F.col("item_id").cast("string").alias("name"), F.col("text").cast("binary").alias("t")).where("name is not null and t is not null").distinct()
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    kept = [f"keep_{i}" for i in range(len(keep))]
    own = "doc_id long, " + "".join(f"{k} {fields[c]}, " for k, c in zip(kept, keep, strict=True))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(k) for k, c in zip(kept, keep, strict=True)], F.col("text").cast("binary").alias("raw"))

    def scan(shared, first: list[str], spans: bool):
        """``first`` of each row and what it has of the block; with ``spans`` only rows that are hit, and where."""

        def run(batches):
            index = shared.value
            for batch in batches:
                rows, at = [], []
                for i, raw in enumerate(batch.column("raw")):
                    words = words_of(raw.as_py())
                    hit, names = index.find(words)
                    if not spans or names:
                        rows.append((len(words), int(hit.sum()), len(names), sorted(names), np.packbits(hit).tobytes() if spans else None))
                        at.append(i)
                release()
                kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "items": pa.list_(pa.string())} | ({"hits": pa.binary()} if spans else {})
                new = {name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(kinds.items())}
                yield with_columns(batch.take(pa.array(at, pa.int32())) if spans else batch, first, **new)

        return run

    def judged(df: DataFrame) -> DataFrame:
        names = [F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)]
        return df.select("doc_id", *names, "n_words", "n_hit", "n_items", "items", ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))

    counts = "n_words long, n_hit long, n_items long, items array<string>"
    digests = source.withColumn("key", F.sha2(F.col("raw"), 256))
    found = None
    for parts, rows in _blocks(named, block_bytes):
        shared = spark.sparkContext.broadcast(Index(rows, length, gram))
        if parts == 1:
            return judged(source.mapInArrow(scan(shared, ["doc_id", *kept], False), own + counts))
        # a text that occurs often is looked up as often as its rows, and kept once
        part = digests.select("key", "raw").mapInArrow(scan(shared, ["key"], True), f"key string, {counts}, hits binary")
        part = cut(part.groupBy("key").agg(*[F.first(c).alias(c) for c in ("n_words", "hits", "items")]))
        shared.unpersist()
        found = part if found is None else found.unionByName(part)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """Of one text: the union of what the blocks hit, a row for each at most."""
        n = int(pdf["n_words"].iloc[0])
        bits = np.bitwise_or.reduce([np.frombuffer(x, dtype=np.uint8) for x in pdf["hits"]])
        names = sorted(set().union(*pdf["items"]))
        return pd.DataFrame([(pdf["key"].iloc[0], int(np.unpackbits(bits, count=n).sum()), len(names), names)], columns=["key", "n_hit", "n_items", "items"])

    def words_only(batches):
        for batch in batches:
            n = [len(words_of(raw.as_py())) for raw in batch.column("raw")]
            yield with_columns(batch, ["doc_id", *kept, "key"], n_words=pa.array(n, pa.int64()))

    merged = found.groupBy("key").applyInPandas(merge, "key string, n_hit long, n_items long, items array<string>")
    out = digests.mapInArrow(words_only, own + "key string, n_words long").join(merged, "key", "left")
    none = F.array().cast("array<string>")
    return judged(out.withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "n_items": F.coalesce("n_items", F.lit(0)), "items": F.coalesce("items", none)}))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(13, len(w)) AS size, array_to_string(w[i : i + least(13, len(w)) - 1], ' ') AS win
  FROM (SELECT item, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT size FROM bw),
dw AS (
  SELECT r, i, size, array_to_string(w[i : i + size - 1], ' ') AS win
  FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
m AS (SELECT dw.r, dw.i, dw.size, bw.item FROM dw JOIN bw USING (size, win)),
hit AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + size)) AS p FROM (SELECT DISTINCT r, i, size FROM m)) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM m) GROUP BY r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(hit.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(its.n, 0) AS BIGINT) AS n_items, sha256(coalesce(its.items, '')) AS items_sha256,
       coalesce(hit.n, 0) > 0 AND 20 * coalesce(hit.n, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN its USING (r)
"""
