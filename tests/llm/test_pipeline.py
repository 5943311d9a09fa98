"""The pipeline's stages against plain versions of their decisions."""

import corpus_pipeline
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.test_near_copies import plain_groups
from tests.llm.test_pairs import plain_decontaminate, plain_substring

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(base / name))
        out[name] = (docs, docs := spark.read.parquet(str(base / name)))
    return out


def test_columns_and_names(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(stages)
    assert all(after.columns == corpus_pipeline.COLUMNS for before, after in list(stages.values())[:-1])


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_documents_with_letters_pass_language_id(stages):
    before, after = stages["language_id"]
    kept = by_id(after)
    assert set(kept) == {i for i, r in by_id(before).items() if any(c.isalpha() for c in r["text"] or "")}
    assert before.join(after.select("doc_id"), "doc_id", "left_semi").select(*after.columns).exceptAll(after).count() == 0


def test_one_document_of_each_group_stays(stages):
    """Groups by all pairs: five words, Jaccard similarity of 0.8 or more."""
    before, after = stages["simhash_near_dedup"]
    groups = plain_groups([(r["doc_id"], r["text"]) for r in before.collect()])
    assert set(by_id(after)) == set(groups.values()) and len(set(groups.values())) < len(groups)
    assert after.exceptAll(before).count() == 0


def test_passages_go(stages):
    before, after = stages["substring_dedup"]
    want = {i: (kept, n, gone) for i, n, gone, kept in plain_substring([(r["doc_id"], r["text"]) for r in before.collect()], 13)}
    got = by_id(after)
    assert set(got) == {i for i, (_, n, gone) in want.items() if not 0 < gone == n} and any(gone for _, _, gone in want.values())
    assert all(b" ".join(r["text"].encode().split()) == want[i][0] and r["n_chars"] == len(r["text"]) for i, r in got.items())


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i for i, _, _, _, _, bad in plain_decontaminate([(r["doc_id"], r["text"]) for r in before.collect()], items, 13) if not bad}
    assert set(by_id(after)) == clean and 0 < len(clean) < before.count()
    assert after.exceptAll(before).count() == 0


def test_every_kept_text_is_encoded(stages):
    before, after = stages["bpe"]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    library.no_padding()
    library.no_truncation()
    got = by_id(after)
    assert {i: list(r["ids"]) for i, r in got.items()} == {i: library.encode(r["text"] or "", add_special_tokens=False).ids for i, r in by_id(before).items()}


def test_run(spark, stages):
    assert corpus_pipeline.run(spark, SF).exceptAll(stages["bpe"][1]).count() == 0


def test_nulls_and_repeated_rows(spark, make_docs):
    """What each stage's docstring says of them."""
    run = lambda k, rows: sorted((r["doc_id"], r["text"]) for r in corpus_pipeline.STAGES[k][1](spark, make_docs(spark, rows), SF).collect())
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    assert run(0, [(1, text), (2, None), (3, ""), (4, "12 ?")]) == [(1, text)]
    assert run(1, [(1, text), (1, text), (2, text), (3, "x y z")]) == [(1, text), (3, "x y z")]
    assert run(2, [(1, text), (1, text), (2, text + " end"), (3, text)]) == [(1, text), (1, text), (2, "end")]
    assert run(3, [(1, text), (1, text), (2, "")]) == [(1, text), (1, text), (2, "")]


def test_odd_rows_go_through(spark, make_docs, odd_texts):
    docs = make_docs(spark, [(i, t, None if k % 3 else "en") for k, (i, t) in enumerate(odd_texts)])
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() > 20


def test_empty_documents_go_through(spark, make_docs):
    docs = make_docs(spark, [(1, "a")]).limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0
