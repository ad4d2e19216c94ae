"""The registered queries of the package that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from plumbline.llm import entry


@pytest.mark.parametrize("name", sorted(entry.ORACLE_SQL))
def test_query_equals_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    got = entry.QUERIES[name](spark, sf)
    want = con.sql(entry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({entry.ORACLE_SQL[name]})").fetchall(), key=str)
