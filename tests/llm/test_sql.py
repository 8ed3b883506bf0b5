"""Operators whose results SQL can express, against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from riskloom.llm import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    con.execute(queries.SQL[name])
    columns = [d[0] for d in con.description]
    assert sorted(columns) == sorted(df.columns)
    want = sorted(tuple(map(str, (r[columns.index(c)] for c in sorted(columns)))) for r in con.fetchall())
    assert sorted(tuple(str(r[c]) for c in sorted(columns)) for r in df.collect()) == want


@pytest.mark.parametrize("name", ["op2_spotsigs", "op3_jaccard_join", "op6_token_store", "op8_packing", "op9_quality", "op10_pii_surrogates"])
def test_query_has_its_columns(spark, name):
    contract = {
        "op2_spotsigs": {"n_chars": "bigint", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"},
        "op3_jaccard_join": {"n_shingles": "bigint", "component_id": "bigint"},
        "op6_token_store": {"start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
        "op8_packing": {"start": "bigint", "length": "bigint", "ids_crc32": "bigint", "doc_tokens": "bigint", "sequence_id": "bigint", "offset": "bigint"},
        "op9_quality": {"held_out": "boolean", "score": "double", "predicted": "int"},
        "op10_pii_surrogates": {"n_entities": "bigint", "text": "string"},
    }[name]
    df = queries.QUERIES[name](spark, DATA)
    assert contract.items() <= dict(df.dtypes).items() and dict(df.dtypes)["doc_id"] == "bigint"
    ids = {r.doc_id for r in df.select("doc_id").collect()}
    assert len(ids) == 200
