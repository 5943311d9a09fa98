"""Substring dedup by level-wise doubling.

A window of the asked length (13 words) can repeat only if every shorter window inside it does. The search begins
with windows of four words and doubles their length level by level up to the asked one. At each level a window of
the asked length stands or falls with the shorter window in it that has the least hash: it stays a candidate only if
that one occurs in another document too, and only candidates are looked at on the next level. A group of documents
without candidates sends nothing more and isn't hashed again; the search ends there.

Documents are dealt by hash into groups of a bounded size. On each level a group sends each distinct hash once, as one
row (hash, group), however many of its documents have it; the rows are dealt by hash, a window function tells which
hashes several documents have, and those come back to their groups. So a passage that a third of all documents share
costs one row for each group, rows grow in proportion to the text, and no task holds more than one group or sorted
rows that spill. The text is shuffled once and read from that exchange on each level.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lexweave.llm._common import HashSet, covered, group_of, mix, n_groups, read, release, sliding_min, window_hashes
from lexweave.llm._words import Words, squeezed, unsqueezed, words_in

#: Words of the shortest windows, if the asked ones are longer.
BASE = 4
#: The multiplier of the second hash of whole windows, of which 32 bits are compared beside the 64 of the first.
SECOND = 0xD1342543DE82EF95
#: Bytes of text in a group: what many documents share is sent once by each group.
GROUP_BYTES = 10 << 20


def levels(length: int, base: int = BASE) -> list[int]:
    """Window lengths: ``base``, twice that and so on; the last is ``length``."""
    out = []
    while base < length:
        out.append(base)
        base *= 2
    return [*out, length]


def array_of(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


NO_HASHES = np.empty(0, dtype=np.uint64)


class Windows:
    """The windows of ``length`` words of a group's documents; a document is known by its id, and one without an id
    takes no part."""

    def __init__(self, table: pa.Table, length: int):
        self.raw = unsqueezed(table.column("raw"))
        self.words: Words = words_in(self.raw)
        ids = table.column("doc_id").combine_chunks()
        named = ids.is_valid().to_numpy(zero_copy_only=False)
        self.doc = ids.fill_null(0).to_numpy()
        self.length = length
        first, n = self.words.first, len(self.words.hash)
        fits = np.zeros(max(0, n - length + 1), dtype=bool)
        for_doc = np.maximum(np.diff(first) - length + 1, 0) * named  # windows of each document
        begin, stop = first[:-1][for_doc > 0], (first[:-1] + for_doc)[for_doc > 0]
        edge = np.zeros(len(fits) + 1, dtype=np.int8)
        np.add.at(edge, begin, 1)
        np.add.at(edge, stop, -1)
        fits[:] = np.cumsum(edge[:-1], dtype=np.int8) > 0
        self.fits = fits

    def least_inside(self, short: int) -> np.ndarray:
        """For each window the least hash of the windows of ``short`` words in it."""
        return sliding_min(window_hashes(self.words.hash, short), self.length - short + 1)

    def candidates(self, short: int, repeated: np.ndarray) -> np.ndarray:
        """Starts of the windows whose least window of ``short`` words is among ``repeated``."""
        at = np.flatnonzero(self.fits)
        return at[HashSet(np.sort(repeated)).has(self.least_inside(short)[at])] if len(at) else at

    def owners(self, at: np.ndarray) -> np.ndarray:
        return self.doc[np.searchsorted(self.words.first, at, side="right") - 1]

    def whole(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of each window at ``at``, and 32 bits of a second one."""
        if not len(at):
            return np.empty(0, dtype=np.uint64), np.empty(0, dtype=np.uint64)
        second = np.zeros(len(at), dtype=np.uint64)
        for k in range(self.length):
            second = second * np.uint64(SECOND) + self.words.hash[at + k]
        return window_hashes(self.words.hash, self.length)[at], mix(second) >> np.uint64(32)


def _rows(g: int, h: np.ndarray, other: np.ndarray | None, doc: np.ndarray) -> pa.Table:
    """One row for each distinct hash. ``tag``: the group, two marks, and the second hash; ``least``, on the last level,
    the least of its documents. The marks: several of its documents have it; the group has another window of this
    first hash, so that an answer has to name the second."""
    order = np.argsort(h) if other is None else np.lexsort((other, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    if other is not None:
        other = other[order]
        new[1:] |= other[1:] != other[:-1]
    first = np.flatnonzero(new)
    least, most = (f.reduceat(doc, first) if len(first) else doc for f in (np.minimum, np.maximum))
    h, tag = h[first], np.int64(g) << 34 | (least != most).astype(np.int64) << 32
    if other is None:
        return pa.table({"h": h.view(np.int64), "tag": tag})
    twin = np.zeros(len(h) + 1, dtype=bool)
    twin[1:-1] = h[1:] == h[:-1]
    tag |= (twin[1:] | twin[:-1]).astype(np.int64) << 33 | other[first].view(np.int64)
    return pa.table({"h": h.view(np.int64), "tag": tag, "least": least})


def _match(h: np.ndarray, other: np.ndarray, known: np.ndarray, known_other: np.ndarray) -> np.ndarray:
    """The place of each pair of hashes in the sorted known ones, -1 without. A known one whose second hash is -1 is
    the only one of its first."""
    out = np.full(len(h), -1)
    i, left = np.searchsorted(known, h), np.arange(len(h))
    while len(left):  # beyond the first turn only where two windows share the first hash
        at = i[left]
        ok = at < len(known)
        left, at = left[ok], at[ok]
        ok = known[at] == h[left]
        left, at = left[ok], at[ok]
        equal = (known_other[at] == other[left].view(np.int64)) | (known_other[at] == -1)
        out[left[equal]] = at[equal]
        left = left[~equal]
        i[left] += 1
    return out


def substring_dedup(docs: DataFrame, length: int = 13, keep: list[str] | None = None, group_bytes: int | None = None) -> DataFrame:
    """Removes each word that a window of ``length`` words covers whose word sequence also starts in a document with
    a smaller doc_id; windows are judged on the input.

    Returns doc_id, the ``keep`` columns, text (kept words joined by one space; the text as it was where nothing
    is removed, null for null), n_words, n_removed. Words are split at ASCII white space and unchanged; a null text
    has none. Rows that share a doc_id are one document to each other and lose nothing to each other. A null doc_id
    is neither smaller nor larger than another: its text stays whole and takes nothing from others. An empty table
    gives no rows. Columns beside those named are not read. Windows are equal if 96 bits of hashes are.
    """
    keep = keep or []
    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    groups = n_groups(docs, "text", group_bytes or GROUP_BYTES)
    kept = [f"keep_{i}" for i in range(len(keep))]
    texts = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(k) for k, c in zip(kept, keep, strict=True)], F.col("text").cast("binary").alias("raw"))
        .withColumn("g", group_of(groups, "doc_id", "raw"))
    )
    dealt = squeezed(texts).groupBy("g")
    stages = levels(length)

    def send(windows: Windows, at: np.ndarray, short: int, g: int) -> pa.Table:
        h, other = (windows.least_inside(short)[at] if len(at) else NO_HASHES, None) if short < length else windows.whole(at)
        doc = windows.owners(at)
        if len(h):  # neighbours of one document often have the same least window
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])
            h, other, doc = h[new], other if other is None else other[new], doc[new]
        out = _rows(g, h, other, doc)
        release()
        return out

    def first_level(key: tuple, table: pa.Table) -> pa.Table:
        windows = Windows(table, length)
        return send(windows, np.flatnonzero(windows.fits), stages[0], key[0].as_py())

    def next_level(short: int, longer: int):
        def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
            repeated = array_of(answers, "h").view(np.uint64)
            if not len(repeated):  # no candidate survives here: the group's search has ended
                return _rows(0, NO_HASHES, None if longer < length else NO_HASHES, np.empty(0, dtype=np.int64))
            windows = Windows(table, length)
            return send(windows, windows.candidates(short, repeated), longer, key[0].as_py())

        return run

    def remove(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        windows = Windows(table, length)
        words, raw = windows.words, windows.raw
        h = array_of(answers, "h").view(np.uint64)
        order = np.argsort(h)
        h = h[order]
        other, least = (answers.column(name).combine_chunks() for name in ("other", "least"))
        any_doc = least.is_null().to_numpy(zero_copy_only=False)[order]  # the group has one document with it, which is late
        other, least = (x.fill_null(default).to_numpy(zero_copy_only=False)[order] for x, default in ((other, -1), (least, 0)))
        n_words, n_removed = np.diff(words.first), np.zeros(table.num_rows, dtype=np.int64)
        if len(h):
            at = np.flatnonzero(windows.fits)
            at = at[HashSet(h).has(window_hashes(words.hash, length)[at])] if len(at) else at
            own, own_other = windows.whole(at)
            found = _match(own, own_other, h, other)
            at, found = at[found >= 0], found[found >= 0]
            gone = covered(at[any_doc[found] | (least[found] < windows.owners(at))], length, len(words.hash))
            n_removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.first])
            texts_, edited = raw.to_pylist(), np.flatnonzero(n_removed)
            for i in edited.tolist():
                a, b = words.first[i], words.first[i + 1]
                left = np.flatnonzero(~gone[a:b]) + a
                texts_[i] = b" ".join([words.data[s:e].tobytes() for s, e in zip(words.start[left].tolist(), words.end[left].tolist(), strict=True)])
            raw = pa.array(texts_, raw.type) if len(edited) else raw
        release()
        return pa.table([table.column("doc_id"), *[table.column(k) for k in kept], raw, n_words, n_removed], ["doc_id", *kept, "raw", "n_words", "n_removed"])

    rows = lambda size: "h long, tag long" + ", least long" * (size == length)
    mark = lambda bit: F.col("tag").bitwiseAND(F.lit(1 << bit)) > 0
    group, several, second = F.shiftright("tag", 34).cast("int"), mark(32), F.col("tag").bitwiseAND(F.lit((1 << 32) - 1))

    def answers_to(sent: DataFrame, size: int) -> DataFrame:
        """What of the sent rows another row or document has; on the last level what a smaller document has: with its id
        if the group has to tell its own documents apart."""
        if size < length:
            return sent.select("h", "tag", F.count("*").over(Window.partitionBy("h")).alias("n")).where((F.col("n") > 1) | several).select(group.alias("g"), "h")
        first = F.min("least").over(Window.partitionBy("h", "second"))
        known = sent.select("h", second.alias("second"), "tag", "least").withColumn("first", first)
        return known.where((F.col("first") < F.col("least")) | several).select(
            group.alias("g"), "h", F.when(mark(33), F.col("second")).alias("other"), F.when(several, F.col("first")).alias("least")
        )

    answers = answers_to(dealt.applyInArrow(first_level, rows(stages[0])), stages[0])
    for short, longer in zip(stages[:-1], stages[1:], strict=True):
        answers = answers_to(dealt.cogroup(answers.groupBy("g")).applyInArrow(next_level(short, longer), rows(longer)), longer)
    own = "".join(f"{k} {fields[c]}, " for k, c in zip(kept, keep, strict=True))
    out = dealt.cogroup(answers.groupBy("g")).applyInArrow(remove, f"doc_id long, {own}raw binary, n_words long, n_removed long")
    return out.select("doc_id", *[F.col(k).alias(c) for k, c in zip(kept, keep, strict=True)], F.col("raw").cast("string").alias("text"), "n_words", "n_removed")


def op6_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(read(spark, sf_dir, "documents"))
    kept = F.array_join(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""), " ")
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce(kept, F.lit("")), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i : i + 12], ' ') AS s
        FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
late AS (SELECT r, i FROM (SELECT r, i, doc_id, min(doc_id) OVER (PARTITION BY s) AS least FROM win) WHERE least < doc_id),
gone AS (SELECT DISTINCT r, p FROM (SELECT r, unnest(range(i, i + 13)) AS p FROM late)),
words AS (SELECT r, doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS x FROM d),
kept AS (SELECT words.r, count(*) AS n, string_agg(x, ' ' ORDER BY words.p) AS s
         FROM words ANTI JOIN gone ON words.r = gone.r AND words.p = gone.p GROUP BY words.r)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(len(d.w) - coalesce(kept.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.s, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""
