"""The queries over the smallest tables: oracle rows, brute force, and columns of the contracts."""

import os

import duckdb
import pytest

from fieldloom.llm import queries

SF = "/root/testdata/sf0.001"
TABLES = "documents pages benchmark labels conversations".split()
COLUMNS = {
    "op2_lm_scores": {"doc_id": "bigint", "held_out": "boolean", "n_tokens": "bigint", "n_known": "bigint", "train_tokens": "bigint", "base_score": "double", "score": "double"},
    "op3_mix_sources": {"doc_id": "bigint", "size": "bigint", "source_size": "bigint", "target": "double", "taken": "bigint"},
    "op4_pii_crf": {"doc_id": "bigint", "n_email": "bigint", "n_ip": "bigint", "n_card": "bigint", "n_phone": "bigint", "base_sha256": "string", "spans": "string"},
    "op5_toxicity": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_html_extract": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op8_exact_dedup": {"doc_id": "bigint", "keep_id": "bigint", "group_size": "bigint", "kept": "boolean", "text_sha256": "string"},
    "op9_simhash_near_dedup": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
}


@pytest.fixture(scope="module")
def oracle():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_oracle(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = oracle.sql(queries.ORACLES[name])
    order = [found.columns.index(c) for c in columns]
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[k] for k in order)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract_columns_and_rows(spark, oracle, name):
    df = queries.QUERIES[name](spark, SF)
    types = dict(df.dtypes)
    assert {c: types.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    table = "pages" if "page_id" in types else "documents"
    assert df.count() == oracle.sql(f"SELECT count(*) FROM {table}").fetchall()[0][0]
