"""BPE encoding and decoding with a pair occurrence index.

A task gathers the distinct words of many documents, lays their symbols out in one array, and indexes every
adjacent pair by its merge rank: rank -> all positions in the block. Active ranks are applied in ascending
order, each to all its positions at once; the neighbours' new pairs enter the lists of their own ranks. Texts
are then put together from the finished words. Every word's merges happen in the order of a word-by-word
encoder, as the least rank over the block is the least rank of each word that has it.
"""

from __future__ import annotations

import hashlib
import heapq
import itertools
import json
import unicodedata
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import read, release

#: A tokenizer file may take so many bytes when broadcast; its size doesn't depend on the corpus.
MAX_TOKENIZER_BYTES = 64 << 20


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte (the public GPT-2 rule)."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


#: Letters and numbers that the ``regex`` module knows and the library's Unicode (16.0) doesn't, by code point.
NEWER = (
    "558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A "
    "11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 "
    "1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)

#: Capital letters that the library lower-cases and Python's tables don't know: first, last, first small one.
CAPITALS = [
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5),
    (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
]
SMALL = {c: small + c - first for first, last, small in CAPITALS for c in range(first, last + 1)}


def newer_letters() -> str:
    """The inside of a character class of NEWER."""
    return "".join(rf"\U{int(first, 16):08x}-\U{int(last or first, 16):08x}" for first, _, last in (run.partition("-") for run in NEWER.split()))


@dataclass
class Vocabulary:
    """What the encoder needs of a tokenizers file of the word-end BPE kind."""

    pattern: str
    newer: str
    special: dict[str, int]
    tokens: list[str]
    inner: np.ndarray
    last: np.ndarray
    pair_keys: np.ndarray
    pair_rank: np.ndarray
    rank_left: np.ndarray
    rank_right: np.ndarray
    rank_new: np.ndarray

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        if len(raw) > MAX_TOKENIZER_BYTES:
            raise ValueError(f"{path}: {len(raw)} characters; at most {MAX_TOKENIZER_BYTES} are broadcast")
        spec = json.loads(raw)
        model, split = spec["model"], spec["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: not a word-end BPE file of the supported kind")
        ids, end = model["vocab"], model["end_of_word_suffix"]
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        names = {v: k for k, v in ids.items()} | {v: k for k, v in special.items()}
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([ids[a] for a, _ in merges], dtype=np.int64)
        right = np.array([ids[b] for _, b in merges], dtype=np.int64)
        keys = left * len(names) + right
        order = np.argsort(keys, kind="stable")
        letters = byte_letters()
        return cls(
            pattern=split["pattern"]["Regex"],
            newer=newer_letters(),
            special=special,
            tokens=[names[i] for i in range(len(names))],
            inner=np.array([ids[c] for c in letters], dtype=np.int32),
            last=np.array([ids[c + end] for c in letters], dtype=np.int32),
            pair_keys=keys[order],
            pair_rank=order.astype(np.int64),
            rank_left=left.astype(np.int32),
            rank_right=right.astype(np.int32),
            rank_new=np.array([ids[a + b] for a, b in merges], dtype=np.int32),
        )


class PairIndex:
    """Symbols of a block of words, and the positions of each mergeable pair by rank."""

    def __init__(self, vocabulary: Vocabulary, words: list[bytes]):
        self.v = vocabulary
        raw = np.frombuffer(b"\n".join(words) + b"\n", dtype=np.uint8)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        self.ends = np.cumsum(lengths + 1) - 1 + 1  # a gap stands before the first word and after each one
        n = len(raw) + 1
        self.sym = np.full(n, -1, dtype=np.int32)
        self.sym[1:] = vocabulary.inner[raw]
        self.sym[self.ends] = -1
        full = self.ends[lengths > 0]
        self.sym[full - 1] = vocabulary.last[raw[full - 2]]
        self.next = np.arange(1, n + 1, dtype=np.int64)
        self.next[-1] = n - 1
        self.prev = np.arange(-1, n - 1, dtype=np.int64)
        self.prev[0] = 0
        self.lists: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []
        self.add(np.arange(n - 1))

    def add(self, at: np.ndarray) -> None:
        """Enters the pairs that start at these positions into the lists of their ranks."""
        a, b = self.sym[at], self.sym[self.next[at]]
        real = (a >= 0) & (b >= 0)
        at = at[real]
        keys = a[real].astype(np.int64) * len(self.v.tokens) + b[real]
        i = np.searchsorted(self.v.pair_keys, keys)
        i[i == len(self.v.pair_keys)] = 0
        hit = self.v.pair_keys[i] == keys
        if not hit.any():
            return
        at, ranks = at[hit], self.v.pair_rank[i[hit]]
        if len(at) > 1:
            order = np.argsort(ranks, kind="stable")
            at, ranks = at[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        else:
            cuts = np.empty(0, dtype=np.int64)
        starts = [0, *cuts.tolist(), len(at)]
        for s, e in itertools.pairwise(starts):
            rank = int(ranks[s])
            if rank not in self.lists:
                self.lists[rank] = []
                heapq.heappush(self.heap, rank)
            self.lists[rank].append(at[s:e])

    def run(self) -> None:
        """Applies the active ranks in ascending order until none is left."""
        sym, nxt, prv = self.sym, self.next, self.prev
        while self.heap:
            rank = heapq.heappop(self.heap)
            parts = self.lists.pop(rank)
            a, b, new = self.v.rank_left[rank], self.v.rank_right[rank], self.v.rank_new[rank]
            at = np.unique(np.concatenate(parts)) if len(parts) > 1 else np.sort(parts[0])
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]
            if a == b and len(at) > 1:  # in a run of equal symbols every second pair counts, from the left
                first = np.ones(len(at), dtype=bool)
                first[1:] = nxt[at[:-1]] != at[1:]
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(first, i, 0))) % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = new, -2
            nxt[at], prv[after] = after, at
            self.add(np.unique(np.concatenate([prv[at], at])))

    def pieces(self) -> tuple[np.ndarray, np.ndarray]:
        """All token ids in order, and how many each word has."""
        live = self.sym >= 0
        before = np.concatenate([[0], np.cumsum(live)])
        counts = np.diff(np.concatenate([[0], before[self.ends]]))
        return self.sym[live], counts


class Encoder:
    """Encodes texts block by block; finished words stay known until ``most_words`` are."""

    def __init__(self, vocabulary: Vocabulary, most_words: int = 120_000):
        self.v, self.most_words = vocabulary, most_words
        self.match = regex.compile(vocabulary.pattern).findall
        # texts with newer letters, which are signs to the library, are split by a pattern that says so
        self.newer = regex.compile(f"[{vocabulary.newer}{''.join(map(chr, SMALL))}]").search
        narrow = vocabulary.pattern.replace(r"[\p{L}]+", rf"(?:(?![{vocabulary.newer}])\p{{L}})+").replace(r"[\p{N}]", rf"(?![{vocabulary.newer}])\p{{N}}")
        self.narrow = regex.compile(narrow.replace(r"[^\s\p{L}\p{N}]+", rf"(?:[{vocabulary.newer}]|[^\s\p{{L}}\p{{N}}])+")).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, vocabulary.special)) + ")")
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = defaultdict(itertools.count().__next__)
        self.ids: list[bytes] = []
        self.text: list[str] = []
        self.counts = np.empty(0, dtype=np.int64)

    @staticmethod
    def normalize(text: str) -> str:
        """NFC, then lower case letter by letter (a sigma doesn't depend on its place)."""
        if text.isascii():
            return text.lower()
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def split(self, text: str) -> list[str]:
        if text.isascii() or not self.newer(text):
            return self.match(text)
        return self.narrow(text.translate(SMALL))

    def words(self, text: str) -> np.ndarray:
        """The text's words as numbers; special tokens in it are words of their own, told by a leading space."""
        known = self.index.__getitem__
        if "<|" not in text:
            found = self.split(self.normalize(text))
        else:
            found = []
            for i, part in enumerate(self.cut.split(text)):
                found += [" " + part] if i % 2 else self.split(self.normalize(part))
        return np.fromiter(map(known, found), dtype=np.uint32, count=len(found))

    def finish(self) -> None:
        """Encodes the words that have come since the last time."""
        fresh = list(itertools.islice(self.index, len(self.ids), None))
        if not fresh:
            return
        plain = [b"" if w[0] == " " else w.encode() for w in fresh]
        block = PairIndex(self.v, plain)
        block.run()
        flat, counts = block.pieces()
        numbers, names = flat.tolist(), self.v.tokens
        ends = np.cumsum(counts).tolist()
        start = 0
        for i, (word, end) in enumerate(zip(fresh, ends, strict=True)):
            if word[0] == " ":
                counts[i] = 1
                own = [self.v.special[word[1:]]]
            else:
                own = numbers[start:end]
            self.ids.append(" ".join(map(str, own)).encode())
            self.text.append(" ".join([names[t] for t in own]))
            start = end
        self.counts = np.concatenate([self.counts, counts])

    def take(self, word_numbers: np.ndarray) -> tuple[int, bytes, str]:
        """Of a text: number of tokens, their decimal ids joined by spaces, the decoded text."""
        own = word_numbers.tolist()
        ids, text = self.ids, self.text
        return int(self.counts[word_numbers].sum()), b" ".join([ids[i] for i in own]), " ".join([text[i] for i in own])


def encode(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, with_text: bool = False, block_bytes: int = 16 << 20
) -> DataFrame:
    """Encodes and decodes every whole text; no shuffle.

    Returns ``id_col``, n_tokens, ids_sha256, decoded_sha256, and, if asked for, ids (array) and decoded. A null
    text counts as empty: no tokens, and digests of the empty string. Repeated rows and null ids give a row each;
    other columns of ``docs`` are not read, whatever their names. A task holds ``block_bytes`` of text at a time.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(tokenizer_path))
    schema = "k long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids + ", decoded string" * with_text

    def run(batches):
        enc = Encoder(shared.value)
        waiting: list[tuple] = []
        held = 0

        def flush():
            enc.finish()
            rows = []
            for key_, numbers in waiting:
                n, ids, text = enc.take(numbers)
                row = [key_, n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode()).hexdigest()]
                if with_ids:
                    row.append(np.array(ids.split(), dtype=np.int32))
                if with_text:
                    row.append(text)
                rows.append(row)
            waiting.clear()
            columns = [("k", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
            columns += [("ids", pa.list_(pa.int32()))] * with_ids + [("decoded", pa.string())] * with_text
            out = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], [name for name, _ in columns])
            if len(enc.ids) > enc.most_words // 2:
                enc.reset()
                release()
            return out

        for batch in batches:
            for key_, raw in zip(batch.column("k").to_pylist(), batch.column("t"), strict=True):
                raw = raw.as_py()
                text = "" if raw is None else raw.decode("utf-8", "replace")
                waiting.append((key_, enc.words(text)))
                held += len(text)
                if held >= block_bytes or len(enc.index) > enc.most_words:
                    yield flush()
                    held = 0
        if waiting:
            yield flush()

    out = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, schema)
    return out.withColumnRenamed("k", id_col)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
