"""Every registered query against its SQL, and the contract of the entry module."""

import glob
import os

import duckdb
import pytest

from quillmark import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def views():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 7)
    if hasattr(value, "isoformat"):
        return str(value)
    if type(value).__name__ == "Decimal":
        return float(value)
    return tuple(map(plain, value)) if isinstance(value, list | tuple) else value


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, views, name):
    df = registry.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    if name not in registry.ORACLES:
        assert rows
        return
    found = views.sql(registry.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    assert sorted((tuple(plain(x[i]) for i in at) for x in found.fetchall()), key=repr) == rows


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 5
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_nothing_else_imports_the_corpus_operators():
    import re
    from pathlib import Path

    for path in Path("quillmark").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"quillmark\.llm|from quillmark import llm|corpus_pipeline", path.read_text()), path
