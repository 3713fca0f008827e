"""Every registered query against its SQL counterpart in DuckDB, full rows."""

import os
import re

import duckdb
import pytest

import __spark_entry__ as entry

# The training-data operators have tests of their own.
OWN = re.compile(r"(?!op\d+_|pipeline$)")
QUERIES, ORACLES = ({k: v for k, v in d.items() if OWN.match(k)} for d in (entry.queries(), entry.oracle_sql()))
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{os.path.join(sf_dir, t)}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(name, spark, sf_dir, duck):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    if name not in ORACLES:
        assert got
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == columns
    want = duck.sql("select " + ", ".join(f'"{c}"' for c in columns) + f" from ({ORACLES[name]}) o").fetchall()
    assert got == sorted(map(repr, want))


def test_names_and_oracles():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) > 100
    assert set(QUERIES) - set(ORACLES) == {"read_documents"}
