"""Every query with SQL gives the SQL's rows."""

import datetime
import os

import duckdb
import pytest

import quire.plans.data_queries as data
import quire.plans.library_queries as library
import quire.plans.parser_queries as parsers
import quire.plans.reference_queries as reference

from .conftest import DATA

QUERIES = {**data.QUERIES, **reference.QUERIES, **library.QUERIES, **parsers.QUERIES}
SQL = {**data.SQL, **reference.SQL, **library.SQL, **parsers.SQL}


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 5)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, db, name):
    df = QUERIES[name](spark, DATA)
    rel = db.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    order = sorted(df.columns)
    a = sorted(([plain(r[c]) for c in order] for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in order]
    assert a == sorted(([plain(r[i]) for i in at] for r in rel.fetchall()), key=repr)
