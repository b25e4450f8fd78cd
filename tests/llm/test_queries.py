"""The corpus queries against their SQL, and the columns that their contracts name."""

import duckdb
import pytest

import corpus_pipeline
from quillmark.llm import queries
from tests.test_queries import plain

FOLDER = "/root/testdata/sf0.001"

COLUMNS = {
    "op1_simhash": {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"},
    "op2_decontamination": {"doc_id": "bigint", "item_id": "bigint"},
    "op3_language_id": {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"},
    "op4_compression_bands": {"doc_id": "bigint", "n_words": "bigint", "word_chars": "bigint", "n_symbols": "bigint", "n_dup_lines": "bigint", "n_repeat_words": "bigint", "base_failed": "boolean", "kept": "boolean"},
    "op5_mixing": {"doc_id": "bigint", "source": "string", "block": "bigint", "mix_slot": "bigint", "mix_position": "bigint"},
    "op6_token_counts": {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"},
    "op7_secrets": {"doc_id": "bigint", "n_assign": "bigint", "n_access": "bigint", "n_hex": "bigint", "base_sha256": "string", "spans": "string"},
    "op8_html_extraction": {"page_id": "bigint", "url": "string", "text": "string", "n_chars": "bigint"},
    "op9_pii": {"doc_id": "bigint", "text": "string"},
    "op10_line_dedup": {"doc_id": "bigint", "n_lines": "bigint", "n_dropped": "bigint", "kept_sha256": "string"},
    "op11_prefix_trie": {"conv_id": "bigint", "depth": "bigint", "parent_conv_id": "bigint", "n_convs": "bigint", "n_children": "bigint", "n_leaves": "bigint", "saved_tokens": "bigint", "ends_sha256": "string"},
    "op12_periodic_runs": {"doc_id": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint", "exponent_milli": "bigint", "runs_sha256": "string", "collapsed_sha256": "string"},
    "op13_substring_dedup": {"doc_id": "bigint", "n_words": "bigint", "n_removed": "bigint", "kept_sha256": "string"},
}


def test_all_are_registered():
    import __spark_entry__ as entry

    assert set(COLUMNS) == set(queries.QUERIES) and {*COLUMNS, "pipeline"} <= set(entry.queries())
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", COLUMNS)
def test_columns_and_rows(spark, name):
    df = queries.QUERIES[name](spark, FOLDER)
    assert COLUMNS[name].items() <= dict(df.dtypes).items()
    table = "pages" if name.startswith("op8") else "documents"
    if name not in ("op2_decontamination", "op11_prefix_trie"):
        assert df.count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


@pytest.mark.parametrize("name", queries.ORACLES)
def test_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{FOLDER}/{table}.parquet')")
    df = queries.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    found = con.sql(queries.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(plain(x[i]) for i in at) for x in found.fetchall()), key=repr) == sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
