"""Registered queries against their SQL in DuckDB, and the contract's columns."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from lexweave.llm.queries import ORACLES, QUERIES
from tests.test_queries import same

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: "vec_id n_links component_id kept", 2: "doc_id held_out lang_pred score", 3: "doc_id fingerprint component_id", 4: "doc_id n_words n_hit n_items items_sha256 contaminated",
    5: "page_id host path rule verdict", 6: "doc_id n_words n_removed kept_sha256", 7: "doc_id held_out n_tokens n_known train_tokens base_score score", 8: "page_id url text n_chars",
    9: "doc_id license", 10: "doc_id n_tokens ids_sha256 decoded_sha256",
    11: "doc_id n_email n_ip n_card n_phone base_sha256 spans", 12: "vec_id component n deviation whitened explained identity_error", 13: "word form root n n_near form_n",
}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name):
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    same(QUERIES[name](spark, SF).toPandas(), c.execute(ORACLES[name]).df())


@pytest.mark.parametrize("number", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, number):
    name = next(n for n in QUERIES if n.startswith(f"op{number}_"))
    out = QUERIES[name](spark, SF)
    assert set(COLUMNS[number].split()) <= set(out.columns)
    if number in (12, 13):  # a row for each component and for each word
        return
    source = {1: "embeddings", 5: "pages", 8: "pages"}.get(number, "documents")
    key = out.columns[0]
    assert out.groupBy(key).agg(F.count("*").alias("n")).exceptAll(spark.read.parquet(f"{SF}/{source}.parquet").groupBy(key).agg(F.count("*").alias("n"))).count() == 0


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(__spark_entry__.queries())
