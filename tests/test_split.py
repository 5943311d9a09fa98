from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F
import pytest

from lexweave.operators.graph import connected_components
from lexweave.operators.indexing import dense_index
from lexweave.operators.split import SplitConfig, assign_splits, split_of, split_summary
from lexweave.sources.jsonl import pairs_from_rows


def pairs(spark, rows):
    return pairs_from_rows(spark, [dict(src_lang=a, src=s, tgt_lang=b, tgt=t) for a, s, b, t in rows])


def labels(spark, rows, config=SplitConfig()):
    return assign_splits(pairs(spark, rows), config, number=True).orderBy("ord").collect()


def test_split_boundaries(spark):
    got = [r[0] for r in spark.createDataFrame([(h,) for h in (0, 9, 10, 19, 20, 1999)], "h int").select(split_of(F.col("h") % 1000)).collect()]
    assert got == ["test", "test", "valid", "valid", "train", "train"]


def test_shared_target_links_different_sources(spark):
    rows = [("en", s, "pt_BR", t) for s, t in [("Run!", "Corre!"), ("Run.", "Corra!"), ("Go.", "Vai."), ("Walk.", "Vai."), ("Walk.", "Ande."), ("Hello.", "Olá.")]]
    assert [r["component"] for r in labels(spark, rows)] == [0, 0, 1, 1, 1, 2]


def test_language_is_part_of_the_key(spark):
    rows = [("en", "Tom.", "pt_BR", "Tom."), ("en", "Mary.", "pt_BR", "Maria."), ("pt_BR", "Maria.", "en", "Mary.")]
    assert [r["component"] for r in labels(spark, rows)] == [0, 1, 1]


def test_empty_sentences_of_a_language_are_one_node(spark):
    rows = [("en", "", "pt_BR", "a"), ("en", "", "pt_BR", "b"), ("en", "x", "en", "X!")]
    got = labels(spark, rows)
    assert [r["component"] for r in got] == [0, 0, 1] and got[0]["least"] == "en\u001f"


def plain_components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=30))
def test_components_are_like_a_plain_version(spark, edges):
    df = spark.createDataFrame(edges, "x long, y long")
    got = {r["node"]: r["component"] for r in connected_components(df, "x", "y").collect()}
    assert got == plain_components([e for e in edges if e[0] != e[1]])


def test_components_of_a_long_path_and_nulls(spark):
    df = spark.range(60).select(F.col("id").alias("x"), (F.col("id") + 1).alias("y")).unionByName(spark.createDataFrame([(None, 5), (7, 7)], "x long, y long"))
    assert {r["component"] for r in connected_components(df, "x", "y").collect()} == {0}


def test_assignment_is_independent_of_order(spark):
    rows = [("en", f"s{i % 7}", "pt_BR", f"t{i % 7} {i // 9}") for i in range(40)]
    config = SplitConfig(300, 300)
    one = {r["src"] + r["tgt"]: r["split"] for r in labels(spark, rows, config)}
    assert one == {r["src"] + r["tgt"]: r["split"] for r in labels(spark, rows[::-1], config)}
    assert len(set(one.values())) > 1


def test_no_sentence_is_in_two_splits(spark):
    rows = [("en", f"s{i % 11}", "pt_BR", f"t{i * i % 23}") for i in range(60)]
    out = assign_splits(pairs(spark, rows), SplitConfig(300, 300))
    assert out.select(F.explode(F.array("a", "b")).alias("k"), "split").groupBy("k").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    assert split_summary(out).agg(F.sum("pairs")).first()[0] == 60


def test_dense_index(spark):
    df = spark.createDataFrame([(g, (i * 37) % 101) for i, g in enumerate("aab" * 30 + "c")], "g string, v int")
    rows = dense_index(df, ["v"], "i", within=["g"]).collect()
    for g in "abc":
        own = sorted((r["v"], r["i"]) for r in rows if r["g"] == g)
        assert [i for _, i in own] == list(range(len(own)))
    assert sorted(r["i"] for r in dense_index(df, ["v"], "i").collect()) == list(range(91))
    assert dense_index(df.limit(0), ["v"], "i").count() == 0


def test_empty_pairs(spark):
    empty = pairs(spark, [("en", "a", "pt_BR", "b")]).limit(0)
    assert assign_splits(empty, number=True).count() == 0


@pytest.mark.parametrize("bad", [{"src_lang": "en"}])
def test_rows_need_all_fields(spark, bad):
    with pytest.raises(KeyError):
        pairs_from_rows(spark, [bad])


def test_counts_come_from_components_alone(spark):
    from lexweave.operators.split import grouped, split_counts

    rows = [("en", "pt_BR", f"word {i % 40}", f"palavra {i % 37}") for i in range(60)] + [("en", "pt_BR", None, "x"), ("en", "pt_BR", "y", None)]
    pairs = spark.createDataFrame(rows, "src_lang string, tgt_lang string, src string, tgt string")
    assert split_counts(pairs).exceptAll(split_summary(assign_splits(pairs))).count() == 0
    keyed, roots, heads = grouped(pairs, keep=[])
    assert keyed.columns[:2] == ["a", "b"] and "src" not in keyed.columns and heads.agg({"pairs": "sum"}).first()[0] == 61


def test_edges_that_meet_no_other_one_stand_apart(spark):
    rows = [(1, 2), (2, 1), (3, 4), (4, 5), (5, 6), (7, 8), (8, 9), (20, 10), (11, 11), (None, 12)]
    df = spark.createDataFrame(rows, "x long, y long")
    want = sorted(connected_components(df, "x", "y").collect())
    assert sorted(connected_components(df, "x", "y", lone_apart=True).collect()) == want and len(want) == 11
    alone = connected_components(df.where("x in (1, 2, 20)"), "x", "y", lone_apart=True).collect()
    assert sorted(map(tuple, alone)) == [(1, 1), (2, 1), (10, 10), (20, 10)]


def test_buckets_without_keys_are_those_of_the_least_keys(spark):
    """Keys that begin alike are told apart by their whole length; others by their beginning alone."""
    from lexweave.operators.split import bucketed, place_splits

    long = "one and the same beginning "
    rows = [("en", "pt_BR", f"{long}{i}", f"alvo {i % 11}") for i in range(60)] + [("en", "pt_BR", f"{i} short", f"{long}{i % 13}") for i in range(60)]
    rows += [("en", "pt_BR", None, "x"), ("en", "pt_BR", "y", None), ("en", "en", "", "a"), ("en", "en", "Same.", "same")]
    pairs = spark.createDataFrame(rows, "src_lang string, tgt_lang string, src string, tgt string").withColumn("ord", F.monotonically_increasing_id())
    config = SplitConfig(300, 300)
    want = sorted(map(tuple, assign_splits(pairs, config, keep=["ord"]).select("ord", "split").collect()))
    assert sorted(map(tuple, place_splits(pairs, config, ["ord"]).collect())) == want and len({s for _, s in want}) == 3
    heads = bucketed(pairs, [])[2]
    assert heads.count() == assign_splits(pairs).select("least").distinct().count() and heads.agg({"pairs": "sum"}).first()[0] == 123
