"""Registered text queries against their SQL in DuckDB."""

import duckdb
import pytest

from hitloom.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want, got = con.sql(ORACLE_SQL[name]), QUERIES[name](spark, SF)
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted(want.select(*got.columns).fetchall(), key=str) == sorted((tuple(r) for r in got.collect()), key=str)
