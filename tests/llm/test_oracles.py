"""The registered operators against DuckDB, where SQL expresses them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from examlens.llm import queries

SF = os.environ.get("LLM_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query(name, spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    assert sorted(con.sql(entry.oracle_sql()[name]).columns) == columns
    want = con.sql("select " + ", ".join(columns) + f" from ({entry.oracle_sql()[name]}) o").fetchall()
    assert got == sorted(map(repr, want))


def test_names():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
    assert set(queries.QUERIES) <= set(entry.queries())
