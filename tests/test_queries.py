"""Every registered query against its check SQL in DuckDB, on the small tables."""

import duckdb
import pytest

import __spark_entry__ as entry

from tools_check import TABLES, rows

QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.sql("SET TimeZone='UTC'")
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_sql(name, spark, sf, duck):
    df = QUERIES[name](spark, sf)
    got = rows(df.columns, df.collect())
    if name not in SQL:
        assert got
        return
    rel = duck.sql(SQL[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert got == rows(rel.columns, rel.fetchall())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["category_id", "products", "mean_score", "mean_price"] and df.count() > 0
