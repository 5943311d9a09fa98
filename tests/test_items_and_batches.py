import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from lexweave.functions.hashing import _mix
from lexweave.operators.cuts import distributed_cells
from lexweave.operators import batches, items, layout
from lexweave.operators.permutation import permuted, restored
from lexweave.operators.scan import running_sums
from lexweave.operators.vocabulary import Dictionary, build_vocabulary, compact_tag, distinct_tokens

ENCODED = "ord long, split string, src_lang string, tgt_lang string, src_ids array<int>, tgt_ids array<int>"


def test_vocabulary(spark):
    df = spark.createDataFrame([([300, 7], [300, 42])], "a array<int>, b array<int>")
    d = Dictionary(build_vocabulary(df, "a", "b"))
    assert len(d) == 9
    x = spark.createDataFrame([([7, 42, 300], [0, 2, 6, 8])], "t array<int>, c array<int>")
    assert x.select(d.encode(F.col("t")), d.decode(F.col("c"))).first() == ([6, 7, 8], [65530, 65532, 7, 300])


def test_tokens_outside_of_the_vocabulary_fail(spark):
    d = Dictionary(build_vocabulary(spark.createDataFrame([([7],)], "a array<int>"), "a"))
    assert spark.createDataFrame([([65530],)], "t array<int>").select(d.encode(F.col("t"))).first()[0] == [0]
    for bad in (8, 0, 70000):
        with pytest.raises(Exception, match="outside of the vocabulary"):
            spark.createDataFrame([([bad],)], "t array<int>").select(d.encode(F.col("t"))).collect()
    with pytest.raises(Exception, match="special token"):
        build_vocabulary(spark.createDataFrame([([65531],)], "a array<int>"), "a").collect()


def test_unknown_language_fails(spark):
    with pytest.raises(Exception, match="unknown language"):
        spark.createDataFrame([("fr",)], "l string").select(compact_tag(F.col("l"))).collect()


def test_both_directions_and_drops(spark):
    rows = [(0, "train", "en", "pt_BR", [10] * 3, [11] * 4), (1, "train", "en", "pt_BR", [10] * 3, []), (2, "train", "en", "pt_BR", [10] * 50, [11]), (3, "test", "en", "pt_BR", [1], [2])]
    pairs = spark.createDataFrame(rows, ENCODED)
    got = items.build_items(pairs, 20, splits=["train"]).orderBy("item_idx").collect()
    assert [(r["ord"], r["dir"], r["src_lang"], r["src_ids"], r["tgt_ids"]) for r in got] == [(0, 0, "en", [10] * 3, [11] * 4), (0, 1, "pt_BR", [11] * 4, [10] * 3)]
    stats = items.build_stats(pairs, 20).where("split = 'train'").first()
    assert tuple(stats) == ("train", 3, 2, 2, 2)
    assert items.build_items(pairs, 20, splits=["valid"]).count() == 0
    assert items.get_item(items.build_items(pairs, 20), "train", 1).count() == 1 and items.get_item(items.build_items(pairs, 20), "train", 2).count() == 0


def test_one_direction_may_be_too_long(spark):
    pairs = spark.createDataFrame([(0, "train", "en", "pt_BR", [1] * 19, [2] * 3)], ENCODED)
    assert [r["dir"] for r in items.build_items(pairs, 20).collect()] == [1]
    assert items.build_items(pairs, 20, both_directions=False).count() == 0


def lengths(spark, src, tgt=1):
    rows = [("train", i, s + 2, tgt + 1) for i, s in enumerate(src)]
    return spark.createDataFrame(rows, "split string, item_idx long, src_len int, tgt_len int")


def grouped(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["batch_id"], r["pos_in_batch"])):
        out.setdefault(r["batch_id"], []).append(r)
    assert list(out) == list(range(len(out))) and all([r["pos_in_batch"] for r in b] == list(range(len(b))) for b in out.values())
    return list(out.values())


def test_batches_group_similar_lengths(spark):
    got = grouped(batches.bucket(lengths(spark, [5, 1, 9, 1, 5, 9, 3]), 2, 1 << 40, 42))
    assert [[r["src_len"] - 2 for r in b] for b in got] == [[1, 1], [3, 5], [5, 9], [9]]


def test_batches_keep_the_token_budget(spark):
    assert [len(b) for b in grouped(batches.bucket(lengths(spark, [1, 1, 1, 10, 10]), 4, 20, 0))] == [3, 1, 1]


def sequential(rows, batch_size, max_tokens):
    """The rule, item by item."""
    out, own, longest = [], [], 0
    for s, t in rows:
        if own and (len(own) == batch_size or (len(own) + 1) * max(longest, s, t) > max_tokens):
            out.append(own)
            own, longest = [], 0
        own.append((s, t))
        longest = max(longest, s, t)
    return out + [own] * bool(own)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(3, 9), st.integers(2, 9)), max_size=60), st.integers(1, 7), st.integers(1, 60))
def test_cells_are_like_the_sequential_rule(lens, batch_size, max_tokens):
    rows = sorted(lens)
    counts = [(s, t, rows.count((s, t))) for s, t in sorted(set(rows))]
    sizes = {}
    for c, (_, _, n) in zip(batches.plan_cells(counts, batch_size, max_tokens), counts, strict=True):
        for o in range(n):
            b, p = (c.batch, c.filled + o) if o < c.room else (c.batch + 1 + (o - c.room) // c.full, (o - c.room) % c.full)
            sizes.setdefault(b, []).append(p)
    want = sequential(rows, batch_size, max_tokens)
    assert [len(sizes[b]) for b in sorted(sizes)] == [len(b) for b in want] and sorted(sizes) == list(range(len(want)))
    assert all(p == list(range(len(p))) for p in sizes.values())


@pytest.mark.parametrize(("seed", "batch_size", "max_tokens", "block"), [(1, 5, 40, 5), (2, 7, 1 << 40, 16), (3, 1, 9, 4), (4, 128, 3072, 1), (5, 6, 3, 50)])
def test_blocks_are_like_the_sequential_rule(spark, seed, batch_size, max_tokens, block):
    """Cells gone over in blocks, over several splits and counts from one to many."""
    rng = np.random.default_rng(seed)
    counts = {}
    for split, n in (("a", 150), ("b", 1), ("c", 33)):
        for s, t in rng.integers(2, 60, size=(n, 2)).tolist():
            counts[split, s, t] = counts.get((split, s, t), 0) + int(rng.choice([1, 1, 1, 2, 5, 300]))
    frame = spark.createDataFrame([(*k, n) for k, n in counts.items()], "split string, src_len int, tgt_len int, n long")
    got = sorted(map(tuple, distributed_cells(frame, batch_size, max_tokens, block).collect()))
    want = []
    for split in "abc":
        own = sorted((s, t, n) for (x, s, t), n in counts.items() if x == split)
        want += [tuple(vars(c).values()) for c in batches.plan_cells(own, batch_size, max_tokens, split)]
    assert got == want


def test_many_kinds_of_lengths(spark):
    """Items of nearly as many kinds as items: batches by blocks equal those of the driver."""
    rng = np.random.default_rng(9)
    rows = [("train" if i % 7 else "valid", i, int(s), int(t)) for i, (s, t) in enumerate(rng.integers(2, 4000, size=(3000, 2)))]
    frame = spark.createDataFrame(rows, "split string, item_idx long, src_len int, tgt_len int")
    one, two = (sorted(map(tuple, batches.bucket(frame, 16, 30_000, 42, gathered=g).collect())) for g in (10**6, 0))
    assert one == two
    with pytest.raises(ValueError):
        distributed_cells(frame, 0, 5)


def test_ties_are_ordered_by_the_seed(spark):
    got = grouped(batches.bucket(lengths(spark, [4] * 50), 100, 1 << 40, 7))
    mixed = _mix(np.arange(50, dtype=np.uint64) ^ np.uint64(7))
    assert [r["item_idx"] for r in got[0]] == np.argsort(mixed).tolist()


def test_batch_size_is_checked():
    with pytest.raises(ValueError):
        batches.plan_cells([(3, 2, 1)], 0, 10)


def test_epoch_order_shuffles_batches_only(spark):
    batched = batches.bucket(lengths(spark, range(40)), 2, 1 << 40, 1)
    one, two = ([r["batch_id"] for r in batches.epoch_order(batched, 42, e).orderBy("place").collect()] for e in (1, 2))
    assert sorted(one) == sorted(two) == list(range(20)) and one != two
    assert one == [r["batch_id"] for r in batches.epoch_order(batched, 42, 1).orderBy("place").collect()]
    assert one == [batches.batch_at(place, 20, 42, 1) for place in range(20)]
    assert batches.epoch_order(batched, 42, 1, "nowhere").count() == 0
    plan = batches.epoch_order(batched, 42, 1)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 3000), st.integers(-(2**62), 2**62))
def test_permutation_and_its_inverse(n, key):
    x = np.arange(n)
    y = permuted(x, n, key)
    assert sorted(y.tolist()) == x.tolist() and (restored(y, n, key) == x).all()


def test_permutation_of_many_numbers():
    n = 10**15 + 7
    x = np.random.default_rng(0).integers(0, n, 1000)
    y = permuted(x, n, 5)
    assert (y >= 0).all() and (y < n).all() and (restored(y, n, 5) == x).all() and len(set(y.tolist())) == len(set(x.tolist()))
    with pytest.raises(ValueError):
        permuted(np.array([7]), 7, 0)


@pytest.mark.parametrize("gathered", [0, 10**6])
def test_stats_of_the_lengths_alone(spark, gathered):
    rng = np.random.default_rng(4)
    rows = [("train" if i % 5 else "valid", i, int(s), int(t)) for i, (s, t) in enumerate(np.minimum(rng.geometric(0.05, size=(1500, 2)) + 2, 60))]
    frame = spark.createDataFrame(rows, "split string, item_idx long, src_len int, tgt_len int")
    want = sorted(map(tuple, batches.batch_stats(batches.bucket(frame, 12, 300, 1)).collect()))
    assert sorted(map(tuple, batches.planned_stats(frame, 12, 300, gathered).collect())) == want


def test_distinct_tokens(spark):
    rng = np.random.default_rng(2)
    rows = [(rng.integers(0, 65536, size=rng.integers(0, 300)).tolist(), None if i % 9 == 0 else rng.integers(0, 300, size=4).tolist()) for i in range(60)] + [([0, 1, 32767, 32768, 32769, 65535], [])]
    df = spark.createDataFrame(rows, "a array<int>, b array<int>")
    got = [r[0] for r in distinct_tokens(df.repartition(6), "a", "b").collect()]
    assert sorted(got) == sorted({x for a, b in rows for x in a + (b or [])})
    assert distinct_tokens(df.limit(0), "a").count() == 0


def test_running_sums_of_a_group_over_several_tasks(spark):
    """One group that fills nearly all ranges beside small ones; nulls add nothing."""
    rows = [("a", i, None if i % 10 == 0 else i, 1) for i in range(500)] + [("b", 0, None, 5), ("b", 1, 7, 5), (None, 3, 2, 2), (None, 4, 2, 2)]
    df = spark.createDataFrame(rows, "g string, at int, x long, y long").repartition(7)
    out = running_sums(df, ["at"], {"xs": F.col("x"), "ys": F.col("y")}, ["g"])
    got = {(r["g"], r["at"]): (r["xs"], r["ys"]) for r in out.collect()}
    want, sums = {}, {}
    for g, at, x, y in sorted(rows, key=lambda r: (r[0] or "", r[1])):
        a, b = sums.get(g, (None, None))
        sums[g] = want[g, at] = ((a or 0) + x if x is not None else a, (b or 0) + y)
    assert got == want
    whole = running_sums(df.where("g = 'a'"), ["at"], {"n": F.lit(1)})
    assert [r["n"] for r in whole.orderBy("at").collect()] == list(range(1, 501))


@pytest.fixture(scope="module")
def padded(spark):
    rows = [("train", 0, 0, "en", "pt_BR", [10, 11, 12], [20], 5, 2), ("train", 0, 1, "pt_BR", "en", [13], [21, 22, 23, 24], 3, 5)]
    df = spark.createDataFrame(rows, "split string, batch_id long, pos_in_batch long, src_lang string, tgt_lang string, src_ids array<int>, tgt_ids array<int>, src_len int, tgt_len int")
    return layout.with_masks(layout.pad_batches(df)).cache()


def test_layout(padded):
    a, b = padded.orderBy("pos_in_batch").collect()
    assert (a["src"], b["src"]) == ([4, 10, 11, 12, 2], [3, 13, 2, 0, 0])
    assert (a["tgt_in"], b["tgt_in"]) == ([1, 20, 0, 0, 0], [1, 21, 22, 23, 24])
    assert (a["tgt_out"], b["tgt_out"]) == ([20, 2, 0, 0, 0], [21, 22, 23, 24, 2])
    assert (a["src_pad_mask"], b["src_pad_mask"]) == ([False] * 5, [False] * 3 + [True] * 2)
    assert (a["tgt_pad_mask"], b["tgt_pad_mask"]) == ([False] * 2 + [True] * 3, [False] * 5)
    for r in (a, b):  # shifted left, one end, padding in the same places
        n = r["tgt_out"].index(2)
        assert r["tgt_in"][1 : n + 1] == r["tgt_out"][:n] and r["tgt_out"].count(2) == 1
        assert [x == 0 for x in r["tgt_in"]] == [x == 0 for x in r["tgt_out"]]


def test_matrices(padded):
    m = layout.to_numpy(layout.matrices(padded).first())
    assert m["src"].shape == (2, 5) and m["src"][1].tolist() == [3, 13, 2, 0, 0] and m["tgt_pad_mask"].sum() == 3
    with pytest.raises(ValueError):
        layout.to_numpy({"batch_size": 0, "src_len": 0, "tgt_len": 0})


def test_single_item_has_no_padding(spark):
    row = [("train", 0, 0, "en", "pt_BR", [5, 6], [7, 8, 9], 4, 4)]
    r = layout.pad_batches(spark.createDataFrame(row, "split string, batch_id long, pos_in_batch long, src_lang string, tgt_lang string, src_ids array<int>, tgt_ids array<int>, src_len int, tgt_len int")).first()
    assert len(r["src"]) == len(r["tgt_in"]) == len(r["tgt_out"]) == 4 and 0 not in r["src"] + r["tgt_in"] + r["tgt_out"]


def test_causal_mask(spark):
    got = spark.range(1).select(layout.causal_mask(3).alias("a"), layout.causal_mask(0).alias("b")).first()
    assert got["a"] == [[False, True, True], [False, False, True], [False] * 3] and got["b"] == []


def test_get_batch(spark):
    batched = batches.bucket(lengths(spark, [5, 1, 9]), 2, 1 << 40, 42)
    assert [x["src_len"] for x in batches.get_batch(batched, "train", 0).first()["items"]] == [3, 7]
    assert batches.get_batch(batched, "train", 9).count() == 0


def test_batch_matrices_are_those_of_the_padded_rows(spark):
    rng = np.random.default_rng(3)
    rows = []
    for b in range(7):
        for k in range(int(rng.integers(1, 6))):
            s, t = (rng.integers(6, 90, size=int(n)).tolist() for n in rng.integers(1, 9, size=2))
            rows.append(("train", b, k, ["en", "pt_BR", "zh_Hans"][k % 3], s, t, len(s) + 2, len(t) + 1))
    df = spark.createDataFrame(rows, "split string, batch_id long, pos_in_batch long, tgt_lang string, src_ids array<int>, tgt_ids array<int>, src_len int, tgt_len int")
    got, want = layout.batch_matrices(df), layout.matrices(layout.pad_batches(df))
    assert got.columns == want.columns and sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
