"""Every registered query with SQL gives what DuckDB gives on the same tables."""

import math

import duckdb
import pytest

from epistola.registry import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


def plain(rows):
    clean = lambda v: None if isinstance(v, float) and math.isnan(v) else round(v, 6) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(map(clean, r)) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    found = duck.execute(ORACLE_SQL[name])
    theirs = [d[0] for d in found.description]
    assert sorted(theirs) == columns
    expected = plain(tuple(r[theirs.index(c)] for c in columns) for r in found.fetchall())
    assert plain(tuple(r) for r in df.select(*[f"`{c}`" for c in columns]).collect()) == expected


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs_without_sql(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
    assert QUERIES[name].__doc__


def test_every_query_names_its_operators():
    assert all(q.__doc__ for q in QUERIES.values())
