"""Registered queries of the training-data operators: columns, whole tables, and SQL where there is some."""

import duckdb
import pytest

from quirefold.llm import queries as llm

COLUMNS = {
    "op1_token_files": {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_quality": {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"},
    "op5_licenses": {"doc_id": "bigint", "n_words": "bigint", "n_base": "bigint", "first_word": "bigint", "last_word": "bigint", "base_labels": "string", "labels": "string", "score": "double"},
    "op6_bpe": {"doc_id": "bigint", "n_tokens": "bigint", "ids_sha256": "string", "decoded_sha256": "string"},
    "op7_url_filter": {"page_id": "bigint", "host": "string", "path": "string", "rule": "string", "verdict": "string"},
    "op8_minhash": {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"},
    "op10_crosspolytope": {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"},
}
TABLE = {"op7_url_filter": "pages", "op10_crosspolytope": "embeddings"}


def test_ten_operators_are_registered():
    assert {int(name[2:].split("_")[0]) for name in llm.queries()} == set(range(1, 11))


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_contract(spark, sf_dir, name):
    df = llm.queries()[name](spark, sf_dir)
    kinds = dict(df.dtypes)
    assert {c: kinds.get(c) for c in COLUMNS[name]} == COLUMNS[name]
    rows = df.collect()
    assert len(rows) == spark.read.parquet(f"{sf_dir}/{TABLE.get(name, 'documents')}.parquet").count()
    if name in llm.oracle_sql():
        con = duckdb.connect()
        for table in ("documents", "pages", "embeddings"):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
        found = con.execute(llm.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        plain = lambda x: round(x, 6) if isinstance(x, float) else x
        assert sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str) == sorted((tuple(map(plain, r)) for r in found.fetchall()), key=str)
