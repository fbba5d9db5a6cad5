"""Every registered query against its SQL in DuckDB."""

import math
import os

import duckdb
import pytest

from hitloom.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


def plain(rows, order):
    def value(v):
        if isinstance(v, float):
            return "nan" if math.isnan(v) else repr(v + 0.0)
        return "null" if v is None else str(v)

    return sorted(tuple(value(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_as_sql(spark, con, name):
    got = registry.QUERIES[name](spark, SF)
    want = con.sql(registry.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    kinds = {n: str(t).replace("INTEGER", "INT").split("(")[0] for n, t in zip(want.columns, want.dtypes, strict=True)}
    mine = {n: {"int": "INT", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}.get(t, t.upper().split("(")[0]) for n, t in got.dtypes}
    assert mine == kinds
    names = sorted(got.columns)
    a, b = plain(got.collect(), [got.columns.index(n) for n in names]), plain(want.fetchall(), [want.columns.index(n) for n in names])
    assert len(a) == len(b)
    assert a == b
    assert a


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0
