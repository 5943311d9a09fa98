"""LM scoring with a log-bilinear model trained by noise-contrastive estimation in numpy.

A token is written as a path of symbols: a frequent token is a symbol of its own; any other one is the class of its last
letters, then that of its first letters, then one of its hash, together a leaf; a token that training has never seen
ends in a branch of its own beside the hashes. The predicted vector of a position is h = C1 r(w-1) + C2 r(w-2) over the
symbols before it. Symbol s has probability proportional to exp(q_s h + b_s); the next steps of the path have count mass
times exp(u h), so that every token's probability follows its context down to its leaf, where tokens share by their
counts. What is taken from the counts for the unseen is the usual absolute discount. All probabilities of a context, of
the known tokens and one unseen in each pair of classes, sum to one. As scores are sums of a part for each context word, one matrix product gives the normalisers of all
contexts at once.

Everything follows from the rows of the table and not from how they are stored. Counts are exact sums over the training
part. Training texts are dealt by hash into shards whose number follows from the text's size, sorted by hash in each; a
shard trains on from common parameters, and the shards' parameters meet in a tree of sums, round after round.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import group_of, mix, n_groups, read, release
from lexweave.llm._words import LOWER, LOWER_VALUES, find, hash_words, texts_of
from lexweave.plans.session import ensure_checkpoint_dir, remove

#: Frequent tokens that are symbols of their own, and the branches of each further step of a path.
HEAD, BRANCHES = 960, 64
SYMBOLS = HEAD + BRANCHES
LEAVES = BRANCHES**3
#: Stands before a text's first token.
START = SYMBOLS
DIMENSIONS = 32
BATCH, NOISE = 4096, 64
#: Step size; rounds, each of which trains on its own part of every shard's texts; bytes of text in a shard.
RATE, ROUNDS, SHARD_BYTES = 0.1, 4, 16 << 20
#: Parameters of so many shards meet in one task of the tree of sums.
FAN_IN = 16
#: Bytes of text that are counted at a time.
COUNT_BYTES = 8 << 20


@dataclass
class Tokens:
    """The tokens of a batch of texts: hash of each, the place of each text's first (and the end), and where words stand."""

    hash: np.ndarray
    first: np.ndarray
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def leaves(self, at: np.ndarray) -> np.ndarray:
        """Leaf of the tokens at these places; so that it is made once for each distinct token."""
        text = np.searchsorted(self.first, at, side="right") - 1
        words = np.flatnonzero(at != self.first[text + 1] - 1)
        own = (at - text)[words]
        out = np.full(len(at), END_LEAF, dtype=np.int32)
        out[words] = _leaves(self.data, self.start[own], self.end[own], self.hash[at[words]])
        return out

    @property
    def leaf(self) -> np.ndarray:
        return self.leaves(np.arange(len(self.hash)))


def _branch(*signs: np.ndarray) -> np.ndarray:
    key = np.zeros(len(signs[0]), dtype=np.uint64)
    for x in signs:
        key = key * np.uint64(256) + x.astype(np.uint64)
    return (mix(key + np.uint64(1)) >> np.uint64(58)).astype(np.int32)


def _leaves(data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Leaf of each word of ``data`` in lower case: classes of its last three and first three letters and its hash."""
    if not len(start):
        return np.empty(0, dtype=np.int32)
    size = end - start
    at = lambda i, ok: np.where(ok, LOWER[data[np.clip(i, 0, len(data) - 1)]], 0)
    last = _branch(LOWER[data[end - 1]], at(end - 2, size > 1), at(end - 3, size > 2))
    front = _branch(LOWER[data[start]], at(start + 1, size > 1), at(start + 2, size > 2))
    return (last * BRANCHES + front) * BRANCHES + (h >> np.uint64(58)).astype(np.int32)


#: The end of a text as a token; it is white space, so no word is equal to it.
_END = np.frombuffer(b"\n", dtype=np.uint8)
END = hash_words(_END, np.array([0]), np.array([1]))[0]
END_LEAF = _leaves(_END, np.array([0]), np.array([1]), np.array([END]))[0]


def tokens_in(column) -> Tokens:
    """Lower-cased (A-Z) words of each text of an Arrow binary column, then the end; a null text has the end only."""
    data, offsets = texts_of(column)
    start, end, first = find(data, offsets)
    h = hash_words(data, start, end, LOWER_VALUES)
    texts = np.arange(len(first) - 1)
    ends, owner = first[1:] + texts, np.repeat(texts, np.diff(first))
    place = np.arange(len(h)) + owner
    out = Tokens(np.full(len(h) + len(texts), END), np.concatenate([[0], ends + 1]), data, start, end)
    out.hash[place] = h
    return out


def pieces(table: pa.Table | pa.RecordBatch, most: int):
    """Slices of a table with about ``most`` bytes of ``raw`` each."""
    sizes = np.diff(texts_of(table.column("raw"))[1])
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // most)) + 1
    for a, b in zip([0, *cut.tolist()], [*cut.tolist(), len(sizes)], strict=True):
        yield table.slice(a, b - a)


def _distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct hashes, the first place of each, and for each place the number of its hash. Only the distinct ones are
    sorted."""
    coded = pa.array(h).dictionary_encode()
    found, code = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    order = np.argsort(found)
    rank, at = np.empty(len(order), dtype=np.int64), np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    number = rank.take(code)
    at[number[::-1]] = np.arange(len(h))[::-1]
    return found[order], at, number


@dataclass
class Statistics:
    """Of the training part: tokens, distinct tokens, the frequent tokens with their counts, of each leaf the tokens and
    distinct tokens without the frequent ones, and how many tokens occur once and twice."""

    tokens: int
    distinct: int
    head: np.ndarray
    head_counts: np.ndarray
    leaf_tokens: np.ndarray
    leaf_distinct: np.ndarray
    once: int
    twice: int

    @property
    def discount(self) -> float:
        """What of each count is kept for tokens that were never seen."""
        return min(0.9, max(0.1, self.once / max(1, self.once + 2 * self.twice)))

    @cached_property
    def mass(self) -> np.ndarray:
        """The mass by class of last letters, of first letters, and hash; in the last place that of the unseen, a little
        more than the discounts so that it is nowhere zero."""
        known = (self.leaf_tokens - self.discount * self.leaf_distinct).reshape(BRANCHES, BRANCHES, BRANCHES)
        unseen = self.discount * self.leaf_distinct.reshape(known.shape).sum(axis=2, keepdims=True) + 1 / BRANCHES
        return np.concatenate([known, unseen], axis=2)

    @cached_property
    def symbol_counts(self) -> np.ndarray:
        head = np.zeros(HEAD)
        head[: len(self.head_counts)] = self.head_counts
        return np.concatenate([head, self.mass.sum(axis=(1, 2))])

    @cached_property
    def _by_hash(self) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(self.head)
        return self.head[order], order

    def symbols(self, h: np.ndarray, leaf: np.ndarray) -> np.ndarray:
        known, rank = self._by_hash
        out = (HEAD + leaf // (BRANCHES * BRANCHES)).astype(np.uint16)
        if len(known):
            i = np.searchsorted(known, h)
            i[i == len(known)] = 0
            own = known[i] == h
            out[own] = rank[i[own]]
        return out


def count(docs: DataFrame) -> DataFrame:
    """h, leaf, n of each distinct token of ``docs`` (raw): partial counts in each piece of text, then sums by hash."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, COUNT_BYTES):
                tokens = tokens_in(piece.column("raw"))
                h, at, number = _distinct(tokens.hash)
                out = [h.view(np.int64), tokens.leaves(at), np.bincount(number, minlength=len(h)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], ["h", "leaf", "n"])
            release()

    parts = docs.mapInArrow(run, "h long, leaf int, n long")
    return parts.groupBy("h").agg(F.first("leaf").alias("leaf"), F.sum("n").alias("n"))


def statistics(counts: DataFrame) -> Statistics:
    """Gathers the most frequent tokens (HEAD rows) and the leaves' totals (LEAVES rows at most)."""
    top = counts.orderBy(F.desc("n"), "h").limit(HEAD).toArrow()
    ones, twos = (F.count_if(F.col("n") == k).alias(name) for k, name in ((1, "ones"), (2, "twos")))
    leaves = counts.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("v"), ones, twos).toArrow()
    n, v = np.zeros(LEAVES, dtype=np.int64), np.zeros(LEAVES, dtype=np.int64)
    at = leaves["leaf"].to_numpy()
    n[at], v[at] = leaves["n"].to_numpy(), leaves["v"].to_numpy()
    tokens, distinct = int(n.sum()), int(v.sum())
    head, head_counts = top["h"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.lexsort((head.view(np.int64), -head_counts))  # whatever the order of arrival
    head, head_counts, leaf = head[order], head_counts[order], top["leaf"].to_numpy()[order]
    np.subtract.at(n, leaf, head_counts)
    np.subtract.at(v, leaf, 1)
    return Statistics(tokens, distinct, head.copy(), head_counts.astype(float), n, v, *(int(leaves[k].to_numpy().sum()) for k in ("ones", "twos")))


NAMES = ("r", "c", "q", "b", "front", "last")


@dataclass
class Parameters:
    """r: context vectors (with START), c: a matrix for each position back, q: symbol vectors, b: biases, front and
    last: vectors of the second and third steps of a path; the vector of the unseen is zero."""

    r: np.ndarray
    c: np.ndarray
    q: np.ndarray
    b: np.ndarray
    front: np.ndarray
    last: np.ndarray

    @classmethod
    def start(cls, counts: np.ndarray, seed: int = 1) -> Parameters:
        rng = np.random.default_rng(seed)
        p = (counts + 1.0) / (counts.sum() + len(counts))
        eye = np.stack([np.eye(DIMENSIONS), 0.5 * np.eye(DIMENSIONS)]).astype(np.float32)
        small = lambda n: (rng.standard_normal((n, DIMENSIONS)) * 0.1).astype(np.float32)
        zero = lambda: np.zeros((BRANCHES, DIMENSIONS), dtype=np.float32)
        return cls(small(SYMBOLS + 1), eye, small(SYMBOLS), np.log(p).astype(np.float32), zero(), zero())

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, n) for n in NAMES]

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in self.arrays()])

    def like(self, flat: np.ndarray) -> Parameters:
        parts = np.split(flat.astype(np.float32), np.cumsum([x.size for x in self.arrays()])[:-1])
        return Parameters(*[p.reshape(x.shape) for p, x in zip(parts, self.arrays(), strict=True)])

    def context_parts(self) -> tuple[np.ndarray, np.ndarray]:
        """What the word one back and the word two back add to the predicted vector."""
        return self.r @ self.c[0], self.r @ self.c[1]


class Trainer:
    """Noise-contrastive estimation with one noise sample of symbols shared by a batch, and for the further steps of a
    path one noise step for each token, drawn by count mass; Adagrad steps."""

    def __init__(self, parameters: Parameters, stats: Statistics, seed: int, squares: np.ndarray | None = None):
        self.p = Parameters(*[x.copy() for x in parameters.arrays()])
        counts = stats.symbol_counts
        noise = (counts + 1.0) / (counts.sum() + len(counts))
        self.log_noise = np.log(NOISE * noise).astype(np.float32)
        self.cumulative = np.cumsum(noise)
        mass = stats.mass
        share = lambda x: (np.cumsum(x, axis=-1) / np.maximum(x.sum(axis=-1, keepdims=True), 1e-9)).astype(np.float32)
        self.front_shares, self.last_shares = share(mass.sum(axis=2)), share(mass[:, :, :BRANCHES].reshape(-1, BRANCHES))
        self.rng = np.random.default_rng(seed)
        flat = np.full(self.p.flat().size, 1e-6, dtype=np.float32) if squares is None else squares
        self.squares = self.p.like(flat)

    @staticmethod
    def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Sums of the rows by index, for all of 0..n-1. Two columns are added as one complex number: half as many sums."""
        order = np.argsort(index, kind="stable")
        index = index.take(order)
        first = np.flatnonzero(np.concatenate([[True], index[1:] != index[:-1]]))
        out = np.zeros((n, rows.shape[1]), dtype=np.float32)
        out[index[first]] = np.add.reduceat(rows.take(order, axis=0).view(np.complex64), first, axis=0).view(np.float32)
        return out

    def _drawn(self, shares: np.ndarray, row: np.ndarray) -> np.ndarray:
        """A place drawn from each of the rows of running shares: the first that reaches a random number, else the last."""
        shares, x = shares.ravel(), self.rng.random(len(row), dtype=np.float32)
        begin = row.astype(np.int64) * BRANCHES
        at, step = begin.copy(), BRANCHES // 2
        while step:
            at += step * (shares.take(at + (step - 1)) < x)
            step //= 2
        return at - begin

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        """In place."""
        np.negative(x, out=x)
        np.exp(np.minimum(x, 80, out=x), out=x)
        x += 1
        return np.reciprocal(x, out=x)

    def _step(self, name: str, gradient: np.ndarray) -> None:
        array, squares = getattr(self.p, name), getattr(self.squares, name)
        squares += gradient * gradient
        array -= RATE * gradient / np.sqrt(squares)

    def _path_step(self, name: str, own: np.ndarray, shares: np.ndarray, row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
        """One further step of the paths: true ones against ones drawn from the rows of ``shares``; the gradient of h."""
        m = len(own)
        index = np.concatenate([own, self._drawn(shares, row)]).astype(np.uint16)
        u = getattr(self.p, name).take(index, axis=0)
        d = self._sigmoid(np.concatenate([np.einsum("ij,ij->i", u[:m], h), np.einsum("ij,ij->i", u[m:], h)]))
        d[:m] -= 1
        d /= np.float32(n)
        by = d[:, None]
        gradient = np.empty_like(u)
        np.multiply(by[:m], h, out=gradient[:m])
        np.multiply(by[m:], h, out=gradient[m:])
        self._step(name, self._sums(index, gradient, BRANCHES))
        u *= by
        return u[:m] + u[m:]

    def batch(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, leaf: np.ndarray) -> None:
        p, n = self.p, len(w)
        parts = p.context_parts()  # products are taken for each symbol, and summed by symbol, not for each place
        h = parts[0].take(one, axis=0)
        h += parts[1].take(two, axis=0)
        false = np.minimum(np.searchsorted(self.cumulative, self.rng.random(NOISE)), SYMBOLS - 1)
        qw, qn = p.q.take(w, axis=0), p.q[false]
        bias = p.b - self.log_noise
        d_true = (self._sigmoid(np.einsum("ij,ij->i", h, qw) + bias[w]) - 1) / np.float32(n)
        d_noise = h @ qn.T
        d_noise += bias[false]
        self._sigmoid(d_noise)
        d_noise /= np.float32(n)
        dh = d_noise @ qn
        qw *= d_true[:, None]
        dh += qw
        rest = np.flatnonzero(w >= HEAD)
        if len(rest):
            own, code = h.take(rest, axis=0), leaf[rest]
            dh[rest] += self._path_step("front", code // BRANCHES % BRANCHES, self.front_shares, code // (BRANCHES * BRANCHES), own, n)
            dh[rest] += self._path_step("last", code % BRANCHES, self.last_shares, code // BRANCHES, own, n)
        against = d_noise.T @ h
        h *= d_true[:, None]
        gradient = self._sums(w, h, SYMBOLS)
        np.add.at(gradient, false, against)
        self._step("q", gradient)
        self._step("b", (np.bincount(w, d_true, SYMBOLS) + np.bincount(false, d_noise.sum(axis=0), SYMBOLS)).astype(np.float32))
        by_one, by_two = self._sums(one, dh, SYMBOLS + 1), self._sums(two, dh, SYMBOLS + 1)
        back = by_one @ p.c[0].T + by_two @ p.c[1].T
        self._step("c", np.stack([p.r.T @ by_one, p.r.T @ by_two]))
        self._step("r", back)


def contexts_of(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols one and two places back; START before each text's first."""
    one, two = np.full(len(symbols), START, dtype=np.uint16), np.full(len(symbols), START, dtype=np.uint16)
    one[1:], two[2:] = symbols[:-1], symbols[:-2]
    begin = first[:-1]
    one[begin] = two[begin] = START
    second = begin[np.diff(first) > 1] + 1
    two[second] = START
    return one, two


def train(learning: DataFrame, stats: Statistics, text_bytes: int, rounds: int = ROUNDS) -> Parameters:
    """Parameters after ``rounds`` over the training texts (key, raw; ``key`` deals them).

    A round trains on its own part of every shard, so each text is learnt from once; after a round the shards'
    parameters and step sizes are averaged by their tokens, in a tree whose tasks hold FAN_IN of them.
    """
    now, squares = Parameters.start(stats.symbol_counts), None
    if not stats.tokens:
        return now
    spark = learning.sparkSession
    shards = max(1, -(-text_bytes // SHARD_BYTES))
    place = lambda salt, n: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n)).cast("int")
    dealt = learning.withColumn("shard", place("shard", shards)).withColumn("round", place("round", rounds))
    schema = "node int, x binary, n long"

    def trained(number: int, shared):
        def run(key: tuple, table: pa.Table) -> pa.Table:
            common, squares, stats = shared.value
            shard = key[0].as_py()
            trainer = Trainer(common, stats, seed=1_000_003 * number + shard, squares=squares)
            total = 0
            for piece in pieces(table.sort_by([("key", "ascending"), ("raw", "ascending")]), COUNT_BYTES):
                tokens = tokens_in(piece.column("raw"))
                h, places, own = _distinct(tokens.hash)
                leaves = tokens.leaves(places)
                w, leaf = stats.symbols(h, leaves).take(own), leaves.take(own)
                one, two = contexts_of(w, tokens.first)
                order = trainer.rng.permutation(len(w))
                for i in range(0, len(w), BATCH):
                    at = order[i : i + BATCH]
                    trainer.batch(w[at], one[at], two[at], leaf[at])
                total += len(w)
            release()
            x = np.concatenate([trainer.p.flat(), trainer.squares.flat()]).astype(np.float64) * total
            return pa.table({"node": pa.array([shard // FAN_IN], pa.int32()), "x": [x.tobytes()], "n": [total]})

        return run

    def add(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("x", "ascending")])  # sums don't depend on the order of arrival
        x = np.sum(np.stack([np.frombuffer(b, dtype=np.float64) for b in table["x"].to_pylist()]), axis=0)
        return pa.table({"node": pa.array([key[0].as_py() // FAN_IN], pa.int32()), "x": [x.tobytes()], "n": [sum(table["n"].to_pylist())]})

    for number in range(rounds):
        shared = spark.sparkContext.broadcast((now, squares, stats))
        made = dealt.where(F.col("round") == number).select("shard", "key", "raw").groupBy("shard").applyInArrow(trained(number, shared), schema)
        nodes = -(-shards // FAN_IN)
        while True:
            made = made.groupBy("node").applyInArrow(add, schema)
            if nodes == 1:
                break
            nodes = -(-nodes // FAN_IN)
        met = made.collect()  # one model
        if met and met[0]["n"]:
            both = np.frombuffer(met[0]["x"], dtype=np.float64) / met[0]["n"]
            now, squares = now.like(both[: len(both) // 2]), both[len(both) // 2 :].astype(np.float32)
        shared.unpersist()
    return now


class Model:
    """Parameters and counts, ready to score: normalisers of all contexts, parts of the path scores."""

    def __init__(self, parameters: Parameters, stats: Statistics):
        self.parameters, self.stats = parameters, stats

    @cached_property
    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Score parts by (symbol one back, symbol), by (two back, symbol), and the log of the normaliser of each pair of
        context symbols: one matrix product."""
        p = self.parameters
        one, two = (x.astype(np.float64) @ p.q.T.astype(np.float64) for x in p.context_parts())
        two += p.b
        top1, top2 = one.max(axis=1, keepdims=True), two.max(axis=1, keepdims=True)
        z = np.log(np.exp(one - top1) @ np.exp(two - top2).T) + top1 + top2.T
        return one.astype(np.float32), two.astype(np.float32), z.astype(np.float32)

    @cached_property
    def paths(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For the two further steps: score parts by context symbols, and masses by what the path had before."""
        mass = self.stats.mass
        parts = self.parameters.context_parts()
        last = np.concatenate([self.parameters.last, np.zeros((1, DIMENSIONS), dtype=np.float32)])
        return [
            (parts[0] @ u.T, parts[1] @ u.T, m.astype(np.float32))
            for u, m in ((self.parameters.front, mass.sum(axis=2)), (last, mass.reshape(-1, BRANCHES + 1)))
        ]

    @cached_property
    def exponentials(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        return [(np.exp(a), np.exp(b), m) for a, b, m in self.paths]

    def log10(self, w: np.ndarray, one: np.ndarray, two: np.ndarray, leaf: np.ndarray, n: np.ndarray) -> np.ndarray:
        """log10 probabilities of tokens with symbols ``w``, leaves and training counts ``n`` after symbols one, two."""
        s1, s2, z = self.tables
        out = (s1[one, w] + s2[two, w] - z[one, two]).astype(np.float64)
        rest = np.flatnonzero(w >= HEAD)
        for i in range(0, len(rest), 4096):
            at = rest[i : i + 4096]
            a, b, code = one[at], two[at], leaf[at]
            seen = n[at] > 0
            steps = (code // BRANCHES**2, code // BRANCHES % BRANCHES), (code // BRANCHES, np.where(seen, code % BRANCHES, BRANCHES))
            for (e1, e2, mass), (before, step) in zip(self.exponentials, steps, strict=True):
                x = e1.take(a, axis=0)
                x *= e2.take(b, axis=0)
                x *= mass.take(before, axis=0)
                out[at] += np.log(x[np.arange(len(at)), step]) - np.log(x.sum(axis=1))
            own = at[seen]
            out[own] += np.log(n[own] - self.stats.discount) - np.log(self.stats.mass.reshape(-1, BRANCHES + 1)[leaf[own] // BRANCHES, leaf[own] % BRANCHES])
        return out / math.log(10)


def score(docs: DataFrame, learns: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every whole text of ``docs``.

    ``learns``: a boolean expression over doc_id that tells the training part. Tokens are lower-cased (A-Z) words and one
    end; a null text has the end only. base_score adds log10((c + 1) / (N + V + 1)) over the tokens, with their counts
    c, all N and V distinct tokens of the training part; score adds the model's log10 probabilities. Without any training
    row N and V are zero and the model keeps the parameters that it starts from. Rows with a null doc_id are scored and teach
    nothing. Repeated rows give a row each, with equal scores. An empty table gives no rows. Other columns are not read.
    Tokens are told apart by 64-bit hashes.
    """
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    groups = n_groups(docs)
    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.expr(learns), F.lit(False)).alias("learns"), F.col("text").cast("binary").alias("raw")
    ).withColumn("g", group_of(groups, "doc_id", "raw"))
    learning = texts.where("learns").select(F.xxhash64("doc_id", "raw").alias("key"), "raw")
    stored = f"{spark.sparkContext.getCheckpointDir()}/lm-{uuid.uuid4()}"
    count(learning.select("raw")).write.parquet(stored)
    stats = statistics(spark.read.parquet(stored))
    remove(spark, stored)
    text_bytes = int(learning.agg(F.sum(F.octet_length("raw")).alias("n")).first()["n"] or 0)
    shared = spark.sparkContext.broadcast(Model(train(learning, stats, text_bytes, rounds), stats))

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        """The group's distinct tokens with their training counts in the group."""
        tokens = tokens_in(table.column("raw"))
        h, _, number = _distinct(tokens.hash)
        own = np.bincount(number, weights=table.column("learns").to_numpy()[tokens.owner()], minlength=len(h)).astype(np.int64)
        release()
        return pa.table({"h": h.view(np.int64), "g": np.full(len(h), key[0].as_py(), dtype=np.int32), "n": own})

    def run(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        model = shared.value
        stats = model.stats
        tokens = tokens_in(table.column("raw"))
        h, at, number = _distinct(tokens.hash)
        learns = table.column("learns").to_numpy()
        n = np.bincount(number, weights=learns[tokens.owner()], minlength=len(h)).astype(np.int64)
        n[np.searchsorted(h, answers["h"].to_numpy().view(np.uint64))] = answers["total"].to_numpy()
        leaves = tokens.leaves(at)
        symbol = stats.symbols(h, leaves)
        base = np.log10(n + 1.0) - np.log10(stats.tokens + stats.distinct + 1.0)
        w = symbol[number]
        one, two = contexts_of(w, tokens.first)
        add = lambda x: np.add.reduceat(x, tokens.first[:-1])
        out = pa.table({
            "doc_id": table.column("doc_id"), "n_tokens": np.diff(tokens.first), "n_known": add((n > 0).astype(np.int64)[number]),
            "base_score": add(base[number]), "score": add(model.log10(w, one, two, leaves[number], n[number])),
        })
        release()
        return out

    dealt = texts.groupBy("g")
    asked = dealt.applyInArrow(ask, "h long, g int, n long")
    same = F.expr("sum(n) OVER (PARTITION BY h)").alias("total"), F.expr("count(*) OVER (PARTITION BY h)").alias("groups")
    answers = asked.select("h", "g", *same).where("groups > 1").select("g", "h", "total")  # else the group's own count is all
    out = dealt.cogroup(answers.groupBy("g")).applyInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "n_tokens", "n_known", F.lit(stats.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    fold = "crc32(cast(doc_id as string)) % 7"
    out = score(read(spark, sf_dir, "documents"), f"{fold} <> 2")
    held = F.coalesce(F.expr(f"{fold} = 2"), F.lit(False)).alias("held_out")
    return out.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")
