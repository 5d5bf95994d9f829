"""Every registered query against its SQL in DuckDB, and against itself on rows in another order."""

import os

import duckdb
import pytest

from evidence_engine.plans import load_all
from evidence_engine.plans.registry import ORACLES, QUERIES

load_all()
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def plain(rows, columns):
    def cell(v):
        return round(v, 7) if isinstance(v, float) else v

    return sorted((tuple(cell(r[columns.index(c)]) for c in sorted(columns)) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, db, name):
    df = QUERIES[name](spark, SF)
    found = db.execute(ORACLES[name])
    columns = [d[0] for d in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert plain([tuple(r) for r in df.collect()], df.columns) == plain(found.fetchall(), columns)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
