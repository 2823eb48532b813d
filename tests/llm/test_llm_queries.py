"""The registered queries: one per operator and the pipeline, over whole tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, rows_of
from tapewright.llm import queries

DIR = "/root/testdata/sf0.01"

# Columns that the contract of each query names.
COLUMNS = {
    "op1": "doc_id item_id score",
    "op2": "doc_id held_out score predicted",
    "op3": "page_id payload_bytes payload_digest record_type refers_to",
    "op4": "doc_id start n_tokens ids_crc32",
    "op5": "doc_id keep_id group_size kept text_sha256",
    "op6": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op7": "doc_id n_tokens ids_sha256 decoded_sha256",
    "op8": "doc_id held_out lang_pred score",
    "op9": "doc_id fingerprint component_id",
    "op10": "page_id host path rule verdict",
    "op11": "vec_id cluster distance cluster_inertia inertia centroid_sha256",
    "op12": "doc_id held_out score predicted",
    "op13": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
}


def test_one_query_per_operator_and_the_pipeline():
    assert {name.split("_")[0] for name in queries.QUERIES} == set(COLUMNS) and len(queries.QUERIES) == 13
    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_columns_and_rows(spark, name):
    got = entry.queries()[name](spark, DIR)
    assert set(COLUMNS[name.split("_")[0]].split()) <= set(got.columns)
    rows = got.collect()
    if name.startswith("op1_"):
        return  # a row per leak
    key, table = next((k, t) for k, t in (("page_id", "pages"), ("vec_id", "embeddings"), ("doc_id", "documents")) if k in got.columns)
    assert sorted(r[key] for r in rows) == sorted(r[key] for r in spark.read.parquet(f"{DIR}/{table}.parquet").select(key).collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got, want = entry.queries()[name](spark, DIR).toArrow(), con.sql(entry.oracle_sql()[name]).to_arrow_table()
    assert sorted(got.column_names) == sorted(want.column_names) and rows_of(got) == rows_of(want)
