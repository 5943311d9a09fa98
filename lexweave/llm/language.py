"""Language ID by multilingual mixture inference.

Each language has a distribution over hashed letter trigrams, counted over all training documents. A document is
taken as a mixture: expectation-maximisation over all learned languages estimates the share of each from its trigrams'
likelihoods. The set of languages begins with the likeliest alone and grows to the mixture's two, three, ... largest
shares; each set's own mixture is fitted, and the set grows for as long as the likelihood less a penalty for each
further language (half the logarithm of the number of trigrams for each free share, as in the Bayesian information
criterion) does. Each document stops by itself. The largest share names its language.
"""

from __future__ import annotations

import sys
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import read, release, with_columns

#: Trigrams are hashed into so many buckets.
BUCKETS = 1 << 15
#: The model that is broadcast has BUCKETS float32 for each language.
MAX_LANGUAGES = 512
SMOOTHING = 0.5
ROUNDS, SET_ROUNDS = 12, 6


@cache
def letters() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: whether it is a letter, and its lower-case form."""
    chars = [chr(i) for i in range(sys.maxunicode + 1)]
    is_letter = np.array([c.isalpha() for c in chars])
    lower = np.arange(sys.maxunicode + 1, dtype=np.uint32)
    for i in np.flatnonzero(is_letter).tolist():
        low = chars[i].lower()
        if len(low) == 1:
            lower[i] = ord(low)
    return is_letter, lower


def trigrams(raw: bytes | None) -> np.ndarray:
    """Buckets of the trigrams around each letter of the whole text; what isn't a letter is one boundary sign."""
    if not raw:
        return np.empty(0, dtype=np.int64)
    text = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
    is_letter, lower = letters()
    mask = is_letter[text]
    at = np.flatnonzero(mask)
    if not len(at):
        return np.empty(0, dtype=np.int64)
    code = np.zeros(len(text) + 2, dtype=np.uint32)
    code[1:-1] = np.where(mask, lower[text], 0)
    h = code[at] * np.uint32(0x9E3779B1) + code[at + 1]
    h = h * np.uint32(0x85EBCA77) + code[at + 2]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE3D)
    return ((h ^ (h >> np.uint32(13))) & np.uint32(BUCKETS - 1)).astype(np.int64)


class Model:
    """Languages in alphabetical order and log likelihoods (bucket, language)."""

    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        p = counts + SMOOTHING
        self.p = (p / p.sum(axis=0)).astype(np.float32)
        self.log_p = np.log(self.p)

    def predict(self, docs: list[np.ndarray], most: int = 1 << 22) -> list[tuple[str, float, list[str], list[float]] | None]:
        """Of each document's trigrams: language, its share, the set of languages, their shares; None without
        trigrams. ``most`` bounds the numbers that are held at a time; no document's answer depends on the others."""
        out: list = [None] * len(docs)
        block: list[tuple[int, np.ndarray, np.ndarray]] = []
        held = 0
        for i, d in enumerate(docs):
            if len(d) and self.languages:
                n = np.bincount(d, minlength=BUCKETS)
                g = np.flatnonzero(n)
                block.append((i, g, n[g]))
                held += len(g) * len(self.languages)
            if block and (held >= most or i == len(docs) - 1):
                for (j, _, _), answer in zip(block, self._mixtures([g for _, g, _ in block], [n for _, _, n in block]), strict=True):
                    out[j] = answer
                block, held = [], 0
        return out

    def _mixtures(self, grams: list[np.ndarray], counts: list[np.ndarray]) -> list[tuple[str, float, list[str], list[float]]]:
        n = len(self.languages)
        entries = Entries(np.concatenate(grams), np.concatenate(counts).astype(np.float64), np.array([len(g) for g in grams]))
        every = np.broadcast_to(np.arange(n), (len(grams), n))
        # all languages together give the order in which they enter the set
        alone = entries.sums(self.log_p[entries.gram] * entries.count[:, None])
        shares = entries.fit(self.p[entries.gram], np.full((len(grams), n), 1.0 / n, dtype=np.float32), ROUNDS)[0]
        order = np.argsort(-shares, axis=1, kind="stable")
        likeliest = np.argmax(alone, axis=1)
        best_score = np.take_along_axis(alone, likeliest[:, None], axis=1)[:, 0].astype(np.float64)
        best: list[tuple[np.ndarray, np.ndarray]] = [(np.array([k]), np.ones(1)) for k in likeliest]
        active = np.arange(len(grams))  # each document stops by itself, when one language more makes it no better
        for size in range(2, n + 1):
            own = entries.of(active)
            chosen = np.take_along_axis(every[active], order[active, :size], axis=1)
            start = np.maximum(np.take_along_axis(shares[active], chosen, axis=1), 1e-4)
            start = (start / start.sum(axis=1, keepdims=True)).astype(np.float32)
            fitted, fit = own.fit(self.p[own.gram[:, None], chosen[own.owner]], start, SET_ROUNDS)
            score = fit - 0.5 * (size - 1) * np.log(own.total)
            better = np.flatnonzero(score > best_score[active])
            for k in better.tolist():
                best[active[k]] = (chosen[k], fitted[k])
            active = active[better]
            best_score[active] = score[better]
            if not len(active):
                break
        out = []
        for languages, weights in best:
            by = np.lexsort((languages, -weights))
            by = by[weights[by] > 0]
            names, weights = [self.languages[k] for k in languages[by]], [float(min(1.0, w)) for w in weights[by]]
            out.append((names[0], weights[0], names, weights))
        return out


class Entries:
    """The distinct trigrams of documents one after the other: bucket and count of each, ``sizes`` by document."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, sizes: np.ndarray):
        self.gram, self.count, self.sizes = gram, count, sizes
        self.starts = np.cumsum(sizes) - sizes
        self.owner = np.repeat(np.arange(len(sizes)), sizes)
        self.total = self.sums(count)

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x, self.starts, axis=0, dtype=np.float64)  # a long text has millions of terms

    def of(self, docs: np.ndarray) -> Entries:
        if len(docs) == len(self.sizes):
            return self
        wanted = np.zeros(len(self.sizes), dtype=bool)
        wanted[docs] = True
        at = np.flatnonzero(wanted[self.owner])
        return Entries(self.gram[at], self.count[at], self.sizes[docs])

    def fit(self, p: np.ndarray, shares: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
        """Expectation-maximisation from ``shares``; the shares and the log likelihood under them."""
        for _ in range(rounds):
            mixed = p * shares.astype(np.float32)[self.owner]
            mixed *= (self.count / mixed.sum(axis=1))[:, None]
            shares = self.sums(mixed) / self.total[:, None]
        inside = (p * shares.astype(np.float32)[self.owner]).sum(axis=1, dtype=np.float64)
        return shares, self.sums(np.log(np.maximum(inside, 1e-30)) * self.count)


def learn(docs: DataFrame) -> Model:
    """Counts trigrams over every row of ``docs`` (text, lang); rows with a null lang teach nothing."""

    def run(batches):
        counts: dict[str, np.ndarray] = {}
        for batch in batches:
            for raw, lang in zip(batch["raw"], batch["lang"], strict=True):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, dtype=np.int64)
                counts[lang] += np.bincount(trigrams(raw), minlength=BUCKETS)
        for lang, n in counts.items():
            at = np.flatnonzero(n)
            # a language without any trigram is known all the same
            at = at if len(at) else np.array([0])
            yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": n[at]})

    labelled = docs.where("lang is not null").select("lang", F.col("text").cast("binary").alias("raw"))
    counts = labelled.mapInPandas(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rows = counts.groupBy("lang").agg(F.collect_list("gram").alias("gram"), F.collect_list("n").alias("n")).orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    if len(rows) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages; raise MAX_LANGUAGES, which bounds what is broadcast")
    table = np.zeros((BUCKETS, len(rows)))
    for k, r in enumerate(rows):
        table[np.array(r["gram"], dtype=np.int64), k] = r["n"]
    return Model([r["lang"] for r in rows], table)


def identify(docs: DataFrame, model: Model, batch_chars: int = 4 << 20, keep: list[str] | None = None) -> DataFrame:
    """doc_id, the ``keep`` columns, lang_pred, score (the share of that language), languages, shares, for every whole text.

    A null text, or one without a letter, is `und` with score 0 and no languages; so is every text if nothing was
    learned. Equal likelihoods take the language first in alphabetical order. Repeated rows and null ids give a row
    each; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    kept = [f"keep_{i}" for i in range(len(keep or []))]

    def run(batches):
        for batch in batches:
            grams: list[np.ndarray] = []
            rows, held = [], 0

            def settle():
                rows.extend(x or ("und", 0.0, [], []) for x in shared.value.predict(grams))
                grams.clear()

            for raw in batch.column("raw"):
                raw = raw.as_py()
                grams.append(trigrams(raw))
                held += len(raw or b"")
                if held >= batch_chars:
                    settle()
                    held = 0
            settle()
            release()
            kinds = pa.string(), pa.float64(), pa.list_(pa.string()), pa.list_(pa.float64())
            new = {name: pa.array([r[i] for r in rows], kind) for i, (name, kind) in enumerate(zip(("lang_pred", "score", "languages", "shares"), kinds, strict=True))}
            yield with_columns(batch, ["doc_id", *kept], **new)

    fields = {f.name: f.dataType.simpleString() for f in docs.schema}
    own = "".join(f"{k} {fields[c]}, " for k, c in zip(kept, keep or [], strict=True))
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).alias(k) for k, c in zip(kept, keep or [], strict=True)], F.col("text").cast("binary").alias("raw"))
    out = source.mapInArrow(run, f"doc_id long, {own}lang_pred string, score double, languages array<string>, shares array<double>")
    return out.select("doc_id", *[F.col(k).alias(c) for k, c in zip(kept, keep or [], strict=True)], "lang_pred", "score", "languages", "shares")


def fold():
    """The contract's fold of a document: crc32 of its id as text, modulo 3."""
    return F.crc32(F.col("doc_id").cast("string")) % 3


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = learn(docs.where(fold() != 1))
    out = identify(docs, model)
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "languages", "shares")
