"""Every core query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from nearpass.plans import registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for f in os.listdir(sf):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda k: names[k])
    show = lambda v: round(v, 9) + 0.0 if isinstance(v, float) else v  # noqa: E731  NaN stays NaN and differs from None
    return sorted(repr([show(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_equals_sql(spark, sf, duck, name):
    out = registry.QUERIES[name](spark, sf)
    want = duck.sql(registry.SQL[name])
    assert sorted(out.columns) == sorted(want.columns)
    assert plain(map(tuple, out.collect()), out.columns) == plain(want.fetchall(), want.columns)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_runs(spark, sf, name):
    out = registry.QUERIES[name](spark, sf)
    assert out.columns and out.count() >= 0


def test_contract():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(registry.QUERIES) <= set(entry.queries())
