import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.functions.tokens import Tokenizer
from lexweave.operators import batches, layout, store
from lexweave.plans import config, fixtures, queries
from lexweave.plans.corpus import Corpus
from lexweave.plans.stored import StoredCorpus
from lexweave.sources import jsonl
from lexweave.sources.artifacts import Artifacts, Conflict
from lexweave.streaming.pairs import ingest, stream_pairs, with_stream_keys

LINE = {"id": "row/17", "src_lang": "en", "tgt_lang": "zh_Hans", "src": "Snow falls.", "tgt": "下雪了", "corpus": "weather", "doc": None, "seg": 7, "more": [1]}


def put(tmp_path, *lines):
    path = tmp_path / "pairs.jsonl"
    path.write_bytes("\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in lines).encode())
    return str(path)


def test_reads_lines_in_order(spark, tmp_path):
    path = put(tmp_path, LINE, " \t ", LINE | {"id": "t-2", "src": "", "seg": 2**64 - 1, "doc": "d"} , {k: v for k, v in LINE.items() if k not in ("doc", "seg")} | {"src": "a\rb"})
    rows = jsonl.read_pairs(spark, path).orderBy("ord").collect()
    assert [r["ord"] for r in rows] == [0, 1, 2] and [r["src"] for r in rows] == ["Snow falls.", "", "a\rb"]
    assert [r["doc"] for r in rows] == [None, "d", None] and [None if r["seg"] is None else int(r["seg"]) for r in rows] == [7, 2**64 - 1, None]


@pytest.mark.parametrize("bad", [
    "{", "[1]", "7", LINE | {"src": 2}, LINE | {"src": None}, {k: v for k, v in LINE.items() if k != "tgt"}, LINE | {"src_lang": "fr"}, LINE | {"seg": -1}, LINE | {"seg": 2**64},
    LINE | {"seg": "7"}, LINE | {"seg": 1.5}, LINE | {"doc": 3}, json.dumps(LINE)[:-1] + ', "src": "x"}',
])
def test_a_bad_line_fails_with_its_place(spark, tmp_path, bad):
    path = put(tmp_path, LINE, "", bad)
    with pytest.raises(Exception, match=r"pairs\.jsonl:3: "):
        jsonl.read_pairs(spark, path).collect()


def test_round_trips(spark, tmp_path):
    rows = jsonl.read_pairs(spark, put(tmp_path, LINE, LINE | {"id": "2", "tgt": "à \"b\"\\"}))
    jsonl.write_pairs(rows, str(tmp_path / "out"))
    again = jsonl.read_pairs(spark, str(tmp_path / "out")).drop("ord")
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, rows.drop("ord").collect()), key=str)
    vocabulary = spark.createDataFrame([(1, 9), (0, 7), (2, 8)], "compact_id int, token_id int")
    for _ in range(2):  # the second one replaces the first
        jsonl.write_vocabulary(vocabulary, str(tmp_path / "v"))
    assert [tuple(r) for r in jsonl.read_vocabulary(spark, str(tmp_path / "v")).orderBy("compact_id").collect()] == [(0, 7), (1, 9), (2, 8)]
    jsonl.write_config(spark, config.TrainingConfig(), str(tmp_path / "c"))
    assert jsonl.read_config(spark, str(tmp_path / "c"))["seed"] == 42


def test_configs():
    full = config.TrainingConfig.full_run()
    assert (full.epochs, full.batch_size, full.max_tokens, full.learning_rate, full.beta_2) == (50, 128, 3072, 5e-4, 0.98)
    assert config.ModelConfig(100).hidden == 1024


def test_smaller_batches_until_memory_suffices():
    seen = []

    def run(c):
        seen.append(c.batch_size)
        if c.batch_size > 16:
            raise RuntimeError("CUDA Out Of Memory")
        return c.max_tokens

    assert config.with_smaller_batches(run, config.TrainingConfig()) == 16 * 24 and seen == [128, 64, 32, 16]
    with pytest.raises(KeyError):
        config.with_smaller_batches(lambda c: {}["x"], config.TrainingConfig())
    with pytest.raises(MemoryError):
        config.with_smaller_batches(lambda c: (_ for _ in ()).throw(MemoryError()), config.TrainingConfig())


def test_first_working():
    def broken():
        raise OSError("no")

    assert config.first_working([("a", broken), ("b", lambda: 2), ("c", lambda: 3)]) == ("b", 2)
    assert config.first_working([("a", broken), ("b", lambda: 2), ("c", lambda: 3)], forced="c") == ("c", 3)
    with pytest.raises(ValueError):
        config.first_working([("a", broken)], forced="x")
    with pytest.raises(RuntimeError, match="a: no"):
        config.first_working([("a", broken)])


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    put(source, LINE, "", LINE | {"id": "2", "src": "Run!"})
    query = ingest(with_stream_keys(stream_pairs(spark, str(source))), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(120)
    assert sorted(r["a"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["en\u001frun", "en\u001fsnow falls"]


def test_golden_counts(spark, tmp_path):
    """The pairs of the small table with the byte tokenizer."""
    corpus = Corpus(fixtures.document_pairs(spark, "/root/testdata/sf0.001"), Tokenizer(spark))
    assert corpus.pairs.count() == 865 and corpus.assigned.select("least").distinct().count() == 727
    assert {r["split"]: r["count"] for r in corpus.assigned.groupBy("split").count().collect()} == {"train": 851, "valid": 7, "test": 7}
    assert len(corpus.dictionary) == 104
    stats = {r["split"]: tuple(r)[1:] for r in corpus.stats().collect()}
    assert stats["train"] == (851, 295, 1407, 0) and stats["valid"][1:3] == (0, 14)
    run = config.TrainingConfig.full_run()
    assert tuple(batches.batch_stats(corpus.batched(run)).where("split = 'train'").first())[1:] == (12, 28, 32415, 53766)
    corpus.save(str(tmp_path / "artifacts"), run)
    stored = StoredCorpus(spark, str(tmp_path / "artifacts"))
    assert stored.vocabulary().count() == 104 and stored.config()["seed"] == 42 and stored.stats().count() == 3
    assert corpus.layout(run).where(F.size("src") != F.col("batch_src_len")).count() == 0


def test_lines_are_numbered_without_an_exchange(spark, tmp_path):
    """Several files of many blocks, long lines over several blocks, blank lines, both line ends."""
    rng = np.random.default_rng(3)
    folder, want = tmp_path / "in", []
    folder.mkdir()
    for name in ("a.jsonl", "b.jsonl", "empty.jsonl", "z.jsonl"):
        lines = []
        for i in range(0 if name.startswith("empty") else 120):
            if rng.random() < 0.2:
                lines.append(rng.choice(["", " \t", "\u3000"]))
            else:
                lines.append(json.dumps(LINE | {"id": f"{name}:{len(lines) + 1}", "src": "x" * int(rng.choice([1, 50, 3000]))}))
                want.append(f"{name}:{len(lines)}")
        (folder / name).write_bytes("\r\n".join(lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        pairs = jsonl.read_pairs(spark, str(folder))
        assert pairs.rdd.getNumPartitions() > 20
        rows = pairs.orderBy("ord").collect()
        plan = pairs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["ord"] for r in rows] == list(range(len(want))) and [r["id"] for r in rows] == want
    assert "Exchange" not in plan and "Sort" not in plan


def test_a_writer_that_dies_leaves_what_stood(spark, tmp_path):
    path = str(tmp_path / "folder")
    artifacts, one, two = Artifacts(spark, path), spark.range(3), spark.range(10)
    assert artifacts.manifest() == {}
    with pytest.raises(LookupError):
        artifacts.folder("rows")
    artifacts.commit("rows", one.write.parquet, kind="a")

    def dies(at):
        two.write.parquet(at)
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        artifacts.commit("rows", dies, kind="b")
    again = Artifacts(spark, path)  # what another process sees
    assert spark.read.parquet(again.folder("rows")).count() == 3 and again.has("rows", kind="a") and not again.has("rows", kind="b")
    assert sum(n.startswith("rows-") for n in os.listdir(path)) == 2
    again.commit("rows", two.write.parquet, kind="b")
    assert spark.read.parquet(artifacts.folder("rows")).count() == 10 and artifacts.facts("rows") == {"kind": "b"}
    assert sum(n.startswith("rows-") for n in os.listdir(path)) == 1  # neither the old version nor the orphan


def test_two_writers_do_not_lose_each_other(spark, tmp_path):
    artifacts = Artifacts(spark, str(tmp_path / "folder"))
    artifacts.commit("a", spark.range(1).write.parquet)

    def meanwhile(at):
        spark.range(2).write.parquet(at)
        Artifacts(spark, artifacts.path).commit("b", spark.range(5).write.parquet)

    with pytest.raises(Conflict):
        artifacts.commit("a", meanwhile)
    assert spark.read.parquet(artifacts.folder("a")).count() == 1 and spark.read.parquet(artifacts.folder("b")).count() == 5


def test_a_run_goes_on_after_the_last_committed_step(spark, tmp_path):
    artifacts, made = Artifacts(spark, str(tmp_path / "run")), []

    def step(name, fails=False):
        def make(rows):
            made.append(name)
            if fails:
                raise RuntimeError(name)
            return spark.range(4) if rows is None else rows.withColumn(name, F.lit(name))

        return name, make

    with pytest.raises(RuntimeError):
        artifacts.resume([step("one"), step("two"), step("three", fails=True)], source="x")
    out = artifacts.resume([step("one"), step("two"), step("three")], source="x")
    assert made == ["one", "two", "three", "three"] and out.columns == ["id", "two", "three"] and out.count() == 4
    artifacts.resume([step("one"), step("two"), step("three")], source="y")  # another input: all of them again
    assert made[4:] == ["one", "two", "three"]


def files_read(df):
    """The rows, how many files their scan has opened, and its plan."""
    rows = df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return rows, sum(leaves.apply(i).metrics().apply("numFiles").value() for i in range(leaves.size())), plan.toString()


def test_look_ups_read_one_file(spark, tmp_path):
    rows = spark.range(10_000).select(F.when(F.col("id") % 10 == 0, "valid").otherwise("train").alias("split"), F.col("id").alias("n"), F.repeat(F.lit("x"), 50).alias("text"))
    path = str(tmp_path / "rows")
    store.write_clustered(rows, path, "n", per=1000)
    stored = store.read_clustered(spark, path)
    assert len(stored.inputFiles()) == 20
    found = store.at(stored, "n", "train", 4321, per=1000)
    got, n, plan = files_read(found)
    assert [r["n"] for r in got] == [4321] and n == 1
    assert "PartitionFilters: [" in plan and "cluster" in plan.split("PartitionFilters: [")[1].split("]")[0] and "EqualTo(n,4321)" in plan
    for split, number in (("train", 10**12), ("nowhere", 1), ("train", 10)):
        assert store.at(stored, "n", split, number, per=1000).count() == 0


def test_tensors_are_the_matrices(spark, tmp_path):
    rows = [("train", b, i, "en", "pt_BR", [6 + i] * (1 + b), [7 + b] * (2 + i), 3 + b, 3 + i) for b in range(5) for i in range(3)]
    df = spark.createDataFrame(rows, "split string, batch_id long, pos_in_batch long, src_lang string, tgt_lang string, src_ids array<int>, tgt_ids array<int>, src_len int, tgt_len int")
    flat = layout.matrices(layout.pad_batches(df))
    store.write_tensors(flat, str(tmp_path / "t"), per=2)
    stored = store.read_clustered(spark, str(tmp_path / "t"))
    for r in flat.collect():
        found = store.at(stored, "batch_id", "train", r["batch_id"], per=2)
        (row,), n, _ = files_read(found)
        got, want = store.to_matrices(row), layout.to_numpy(r)
        assert n == 1 and all((got[k] == want[k]).all() and got[k].shape == want[k].shape for k in got)
    empty = spark.createDataFrame([([],), (None,), ([1, None],)], "src array<int>").select(store._packed(F.col("src")).alias("b")).collect()
    assert [None if r["b"] is None else bytes(r["b"]) for r in empty] == [b"", None, bytes([1, 0, 0, 0, 0, 0, 0, 0])]


def test_stored_corpus(spark, tmp_path):
    corpus, run = Corpus(fixtures.document_pairs(spark, "/root/testdata/sf0.001"), Tokenizer(spark)), config.TrainingConfig.full_run()
    stored = corpus.save(str(tmp_path / "s"), run, per_items=100, per_batches=4, per_tensors=2)
    versions = {k: v["version"] for k, v in stored.artifacts.manifest().items()}
    again = corpus.save(str(tmp_path / "s"), run, resume=True, per_items=100, per_batches=4, per_tensors=2)
    assert {k: v["version"] for k, v in again.artifacts.manifest().items()} == versions
    assert len(stored) == corpus.items.count()
    want = corpus.items.where("split = 'train' AND item_idx = 123").drop("cluster").first()
    (got,), n, _ = files_read(stored.item("train", 123))
    assert got.asDict() == want.asDict() and n == 1
    assert [r["pos_in_batch"] for r in stored.batch("train", 1).orderBy("pos_in_batch").collect()] == list(range(stored.tensor("train", 1).first()["batch_size"]))


def test_ids_wait_for_no_split_and_batches_carry_none(spark, monkeypatch):
    rows = [{"id": str(i), "src_lang": "en", "tgt_lang": "pt_BR", "src": f"ab{'c' * i}", "tgt": "d" * (i % 5)} for i in range(9)]
    run = config.TrainingConfig.full_run()
    planned = Corpus(jsonl.pairs_from_rows(spark, rows), Tokenizer(spark)).planned(run)
    assert not any(c in planned.columns for c in ("src", "tgt", "src_ids", "tgt_ids")) and planned.count() == 14
    monkeypatch.setattr("lexweave.operators.split.connected_components", lambda *a: pytest.fail("components"))
    corpus = Corpus(jsonl.pairs_from_rows(spark, rows), Tokenizer(spark))
    assert corpus.vocabulary.count() == 10 and corpus.coded.where("ord = 1").first()["src_ids"] == [6, 7, 8]


def test_a_line_is_parsed_once(spark, tmp_path):
    """The check of the lines is a filter; pushed below the parse, it would parse each line for every look at a field."""
    jsonl.write_pairs(jsonl.pairs_from_rows(spark, [{"src_lang": "en", "tgt_lang": "pt_BR", "src": "a", "tgt": "b"}]), str(tmp_path / "pairs"))
    plan = jsonl.read_pairs(spark, str(tmp_path / "pairs"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("parseJson") == 1


def test_texts_that_fit_no_item_are_not_moved(spark, tmp_path):
    """Splits, items and batches move digests, sizes and short texts; long texts stay where they are read."""
    rng = np.random.default_rng(5)
    noise = lambda n: rng.bytes(n // 2).hex()
    rows = [(i, f"{noise(8000)}\n{noise(8000)}\nshort {i}\nkurz {i % 7}", "en") for i in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    store, bus = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jsc.sc().listenerBus()

    def moved():
        bus.waitUntilEmpty()
        return store.executorSummary("driver").totalShuffleWrite()

    for name, n in (("q_build_stats", None), ("q_epoch_order", None), ("q_items", 240), ("q_pad", 240)):
        before = moved()
        rows = queries.QUERIES[name](spark, str(tmp_path)).collect()
        assert n is None or len(rows) == n
        assert moved() - before < 600_000, name  # the texts have 1.9 MB and don't compress below a half


def test_pairs_that_are_numbered_late_make_the_same_items(spark):
    rows = [(k // 2, k % 2 * 2, "en", "pt_BR", f"ab{'c' * k}", "d" * (k % 5)) for k in range(24)]
    late = spark.createDataFrame(rows, "doc_id long, p int, src_lang string, tgt_lang string, src string, tgt string")
    given = late.withColumn("ord", F.col("doc_id") * 2 + F.col("p") / 2).withColumn("ord", F.col("ord").cast("long")).drop("doc_id", "p")
    run = config.TrainingConfig.full_run()
    one, two = Corpus(late, Tokenizer(spark), max_length=20, order=["doc_id", "p"]), Corpus(given, Tokenizer(spark), max_length=20)
    got, want = (sorted(map(tuple, c.batched(run).collect()), key=str) for c in (one, two))
    assert got == want and len(want) > 10
    assert sorted(map(tuple, one.epoch_order(run, 1).collect())) == sorted(map(tuple, batches.epoch_order(two.planned(run), run.seed, 1).collect()))
    with pytest.raises(ValueError):
        Corpus(late, Tokenizer(spark), order=["doc_id", "p"], texts=False).batched(run)
