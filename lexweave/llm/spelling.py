"""Spelling variants: a self-join of the vocabulary's trie, in which each node carries the nodes within one edit of it.

Words are dealt so that every pair at distance one meets in one part. Where two words of lengths g and g or g + 1 part after
``at`` equal code points, they share what lies before and what lies behind. The places from ``low`` to below ``high`` are a part's own:
its words share their first ``low`` and their last g - ``high`` code points, and it finds the pairs that part at such a place. All
places are halved once, into words that share a beginning and words that share an end; a part with too many words is halved
again, down to single places, where nothing but the one code point is free.

Inside a task all parts' tries are grown level by level as sorted arrays. A node's active nodes are those of its own depth at one
replacement (kept once, the smaller first) and those one deeper at one insertion; a child's come from its parent's by the same
letter, and new ones from its siblings and its children. At the last level the terminal pairs are left.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from lexweave.llm._common import read, release
from lexweave.plans.session import cut, shuffle_partitions

#: Maximal runs of at least so many letters; all letters lie below U+0100.
LEAST_LENGTH = 7
LETTERS = r"A-Za-zÀ-ÿ"
LEAST_COUNT = 2
#: A form occurs so many times as often as what it is the form of.
TIMES = 10
#: Words that a part holds before it is halved, and rows of parts that one group of a task has on average.
PART_WORDS, GROUP_ROWS = 4_000, 60_000
#: Rounds of following forms: each doubles the steps, and each step multiplies the count by TIMES.
MOST_ROUNDS = 6


def vocabulary(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, n: the distinct words of at least seven letters that occur twice or more. A run of letters loses the code point at
    crc32 modulo its length if 31 divides the crc32 of ``<doc_id>:<run>``; a null id loses none."""
    key = F.col(doc_id).cast("string").alias("doc")
    runs = docs.select(key, F.explode(F.regexp_extract_all(F.col(text).cast("string"), F.lit(f"[{LETTERS}]{{{LEAST_LENGTH},}}+"), 0)).alias("run"))
    low = F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    keyed = runs.select("doc", low.alias("run")).select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = F.pmod("h", F.length("run").cast("long")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = keyed.select(F.when(F.pmod("h", F.lit(31)) == 0, shorter).otherwise(F.col("run")).alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_COUNT)


def _keyed(parts: DataFrame) -> DataFrame:
    """Parts with their key: the shorter length, the places, and what all their words share."""
    shared = F.concat(F.substring("word", F.lit(1), F.col("low")), F.lit("|"), F.when(F.col("high") < F.col("g"), F.expr("right(word, g - high)")).otherwise(F.lit("")))
    return parts.withColumn("key", F.concat_ws(":", "g", "low", "high", shared))


def _halved(parts: DataFrame) -> DataFrame:
    middle = F.floor((F.col("low") + F.least("high", "g")) / 2).cast("int")
    ends = F.array(F.struct(F.col("low"), middle.alias("high")), F.struct(middle.alias("low"), F.col("high")))
    return parts.select("word", "n", "g", F.inline(ends))


def parts_of(words: DataFrame, most: int = PART_WORDS) -> DataFrame:
    """key, g, low, high, word, n: every word in the parts where its pairs are found, none with over ``most`` words that can be
    halved. A word of length m is the longer or an equal one at g = m, and the longer one at g = m - 1."""
    length = F.length("word")
    whole = words.select("word", "n", F.explode(F.array(length, length - 1)).alias("g")).where(f"g >= {LEAST_LENGTH}")
    parts = _keyed(_halved(whole.select("word", "n", "g", F.lit(0).alias("low"), (F.col("g") + 1).alias("high"))))
    done = None
    while True:
        free = F.least("high", "g") - F.col("low")
        sizes = parts.groupBy("key", "g", "low", "high").agg(F.count("*").alias("size"))
        crowded = cut(sizes.where((F.col("size") > most) & (free > 1)).select("key"))
        if crowded.isEmpty():
            return parts if done is None else done.unionByName(parts)
        kept = parts.join(crowded, "key", "left_anti")
        done = kept if done is None else done.unionByName(kept)
        parts = cut(_keyed(_halved(parts.join(crowded, "key", "left_semi"))))


def _expand(first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of ``count`` numbers from ``first``: the range of each number, and the number."""
    owner = np.repeat(np.arange(len(count)), count)
    return owner, first[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)


class Level:
    """The nodes of one depth, sorted: ``code`` is the parent's number * 256 + the code point. ``ended`` has the row whose word
    ends at a node, -1 where none does; ``long`` tells which nodes lead to a word of the longer kind, ``short`` to one of the other."""

    def __init__(self, code: np.ndarray, node: np.ndarray, row: np.ndarray, ends: np.ndarray, is_long: np.ndarray, parents: int):
        self.code, self.size = code, len(code)
        self.ended = np.full(self.size, -1, dtype=np.int64)
        self.ended[node[ends]] = row[ends]
        self.long, self.short = np.zeros(self.size, dtype=bool), np.zeros(self.size, dtype=bool)
        self.long[node[is_long]] = True
        self.short[node[~is_long]] = True
        self.first = np.searchsorted(code, np.arange(parents + 1) * 256)

    def children(self, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in ``parent`` and node of each child."""
        return _expand(self.first[parent], self.first[parent + 1] - self.first[parent])

    def siblings(self) -> tuple[np.ndarray, np.ndarray]:
        """Every two nodes of one parent, the smaller first; those that lead to short words only."""
        x = np.flatnonzero(self.short)
        parent = self.code[x] >> 8
        last = np.searchsorted(parent, parent, "right")
        owner, other = _expand(np.arange(len(x)) + 1, last - np.arange(len(x)) - 1)
        return x[owner], x[other]

    def child(self, parent: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The child by a letter; -1 if there is none."""
        if not self.size:
            return np.full(len(parent), -1, dtype=np.int64)
        code = parent * 256 + letter
        at = np.minimum(np.searchsorted(self.code, code), self.size - 1)
        return np.where(self.code[at] == code, at, -1)


def levels_of(root: np.ndarray, roots: int, letters: np.ndarray, start: np.ndarray, length: np.ndarray, is_long: np.ndarray) -> list[Level]:
    """The tries of all rows, one under each root, from the roots down."""
    rows = np.arange(len(root))
    out = [Level(np.arange(roots) * 256, root, rows, length == 0, is_long, roots)]
    node, depth = root, 0
    while True:
        more = length[rows] > depth
        rows, node = rows[more], node[more]
        if not len(rows):
            return out
        code, node = np.unique(node * 256 + letters[start[rows] + depth], return_inverse=True)
        depth += 1
        out.append(Level(code, node, rows, length[rows] == depth, is_long[rows], out[-1].size))


def _both(x: np.ndarray, y: np.ndarray, under_x: Level, under_y: Level) -> tuple[np.ndarray, np.ndarray]:
    """Children of the active pairs (x, y) by the same letter."""
    owner, xc = under_x.children(x)
    yc = under_y.child(y[owner], under_x.code[xc] & 255)
    return xc[yc >= 0], yc[yc >= 0]


def near_pairs(levels: list[Level]) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) at distance one under the same root, each pair once: both short, or i short and j long. The short rows of a
    root have one length, the long ones one more; rows of a root are distinct."""
    out = []
    empty = np.empty(0, dtype=np.int64)
    replaced = inserted = (empty, empty)
    for depth, level in enumerate(levels):
        deeper = levels[depth + 1] if depth + 1 < len(levels) else None
        if depth:
            x, y = _both(*replaced, level, level)
            ok = level.short[x] & level.short[y]
            replaced = tuple(np.concatenate(p) for p in zip((x[ok], y[ok]), level.siblings(), strict=True))
        i, j = (level.ended[x] for x in replaced)
        ok = (i >= 0) & (j >= 0)
        ok[ok] = level.short[replaced[0][ok]] & level.short[replaced[1][ok]]
        out.append((i[ok], j[ok]))
        if deeper is None:
            break
        x, y = _both(*inserted, level, deeper) if depth else inserted
        owner, child = deeper.children(np.arange(level.size))
        x, y = np.concatenate([x, owner]), np.concatenate([y, child])
        ok = level.short[x] & deeper.long[y]
        both = np.unique(x[ok] * (deeper.size + 1) + y[ok])  # an insertion in a run of one letter is met at several places
        inserted = both // (deeper.size + 1), both % (deeper.size + 1)
        i, j = level.ended[inserted[0]], deeper.ended[inserted[1]]
        ok = (i >= 0) & (j >= 0)
        out.append((i[ok], j[ok]))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def latin(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of strings below U+0100 in one array, and where each string starts and how long it is."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if column.buffers()[2] is not None else np.empty(0, dtype=np.uint8)
    lead = data >= 0xC0  # two bytes make a code point from U+0080 on
    before = np.concatenate([[0], np.cumsum(~lead)])
    points = np.where(data >= 0x80, (data & 0x3F) | 0xC0, data)[~lead]
    ends = before[offsets - offsets[0]]
    return points.astype(np.int64), ends[:-1], np.diff(ends)


def _near(table: pa.Table) -> pa.Table:
    """word, links, best_n, best: what the parts of a group know of each word that has near ones there."""
    column = lambda name: pa.concat_arrays(table.column(name).chunks)
    word, key = column("word"), column("key").dictionary_encode()
    root, roots = key.indices.to_numpy().astype(np.int64), len(key.dictionary)
    n, g, low, high = (column(c).to_numpy().astype(np.int64) for c in ("n", "g", "low", "high"))
    points, start, length = latin(word)
    behind = np.maximum(g - high, 0)
    kept = np.bincount(root, minlength=roots)[root] > 1
    at = np.flatnonzero(kept)
    levels = levels_of(root[at], roots, points, (start + low)[at], (length - low - behind)[at], (length > g)[at])
    i, j = near_pairs(levels)
    i, j = at[i], at[j]
    # a pair belongs to the part that has the place where its words part
    apart = np.zeros(len(i), dtype=np.int64)
    open_ = np.arange(len(i))
    while len(open_):
        d = apart[open_]
        going = (d < length[i[open_]]) & (d < length[j[open_]])
        open_, d = open_[going], d[going]
        same = points[start[i[open_]] + d] == points[start[j[open_]] + d]
        open_ = open_[same]
        apart[open_] += 1
    own = (apart >= low[i]) & (apart < high[i])
    a, b = np.concatenate([i[own], j[own]]), np.concatenate([j[own], i[own]])
    used = np.unique(b)
    rank = np.empty(len(n), dtype=np.int64)
    rank[used[pc.array_sort_indices(word.take(pa.array(used))).to_numpy()]] = np.arange(len(used))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    first = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, dtype=np.int64)
    out = pa.table({
        "word": word.take(pa.array(a[first])), "links": np.diff(np.append(first, len(a))), "best_n": n[b[first]], "best": word.take(pa.array(b[first])),
    })
    release()
    return out


def near_words(words: DataFrame, most: int = PART_WORDS) -> DataFrame:
    """word, n_near, near_n, near: of each word (word, n) with others at distance one their number and the one of largest n, the
    smallest in code-point order among equals."""
    parts = parts_of(words, most)
    groups = max(shuffle_partitions(words.sparkSession), -(-4 * words.count() // GROUP_ROWS))
    dealt = parts.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))
    found = dealt.groupBy("bucket").applyInArrow(_near, "word string, links long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("less"), F.col("best"))).alias("best")
    return found.groupBy("word").agg(F.sum("links").alias("n_near"), best).select("word", "n_near", (-F.col("best.less")).alias("near_n"), F.col("best.best").alias("near"))


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: what the last of its forms is. Each round doubles the steps that are followed."""
    now = cut(forms.select("word", F.col("form").alias("root")))
    for _ in range(MOST_ROUNDS):
        further = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if now.join(further, "root", "left_semi").isEmpty():
            return now
        now = cut(now.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    raise RuntimeError("forms that don't end")


def spelling_variants(words: DataFrame, times: int = TIMES, most: int = PART_WORDS) -> DataFrame:
    """word, form, root, n, n_near, form_n for every word (word, n) of letters below U+0100, at least seven each.

    Near words differ by one inserted, deleted or replaced code point. A word's form is its near word of largest n (the
    smallest in code-point order among equals) if that occurs at least ``times`` (above 1) as often; its root what following
    forms ends at, itself without one. Words are distinct; a word of one kind of text or source weighs like any other. An empty
    table gives no rows. Other columns are not read.
    """
    words = cut(words.select("word", F.col("n").cast("long").alias("n")))
    near = near_words(words, most).withColumnRenamed("word", "of")
    met = words.join(near, F.col("word") == F.col("of"), "left")
    is_form = F.col("near_n") >= F.col("n") * times
    named = cut(met.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("near")).alias("form"), F.when(is_form, F.col("near_n")).alias("form_n")))
    roots = roots_of(named.where("form IS NOT NULL")).withColumnRenamed("word", "of")
    return named.join(roots, F.col("word") == F.col("of"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(vocabulary(read(spark, sf_dir, "documents")))


OP13_SQL = r"""
WITH RECURSIVE bytes AS (
  SELECT list_transform(range(256), lambda i: list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS times
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{00C0}-\x{00FF}]{7,}')) AS run FROM documents) GROUP BY ALL),
coded AS (
  SELECT run, times, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR) || ':' || run, ''),
         lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM runs),
hashed AS (
  SELECT run, times, xor(list_reduce([4294967295] || list_transform(b, lambda x: CAST(x AS BIGINT)), lambda c, x: xor(c >> 8, t[CAST(xor(c & 255, x) AS BIGINT) + 1])), 4294967295) AS h
  FROM coded, bytes),
said AS (
  SELECT CASE WHEN h IS NOT NULL AND h % 31 = 0 THEN run[: h % length(run)] || run[h % length(run) + 2 :] ELSE run END AS word, times FROM hashed),
words AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM said WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
cuts AS (
  SELECT word, n, p, word[: p - 1] || word[p + 1 :] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS p FROM words)),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cuts a JOIN cuts b ON a.p = b.p AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cuts a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cuts a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS most, arg_min(other, (-n, other)) AS other FROM near GROUP BY word),
formed AS (
  SELECT words.word, words.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 10 * words.n THEN other END AS form, CASE WHEN most >= 10 * words.n THEN most END AS form_n
  FROM words LEFT JOIN best USING (word)),
steps AS (
  SELECT word, form AS root, 1 AS k FROM formed WHERE form IS NOT NULL
  UNION ALL SELECT steps.word, formed.form, k + 1 FROM steps JOIN formed ON formed.word = steps.root WHERE formed.form IS NOT NULL),
ends AS (SELECT word, arg_max(root, k) AS root FROM steps GROUP BY word)
SELECT formed.word, form, coalesce(ends.root, formed.word) AS root, n, CAST(n_near AS BIGINT) AS n_near, CAST(form_n AS BIGINT) AS form_n
FROM formed LEFT JOIN ends USING (word)
"""
