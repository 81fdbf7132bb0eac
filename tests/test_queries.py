"""Every registered query of the dialogue engine runs, and those with SQL give what DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from turnmill.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def values(df):
    def one(v):
        if v is None or v is pd.NA or v != v:
            return ""
        return str(v) if isinstance(v, (bool, str)) or not hasattr(v, "__float__") else f"{float(v):.6g}"

    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    got = catalog.queries()[name](spark, DIR).toPandas()
    sql = catalog.oracle_sql().get(name)
    if sql:
        want = duck.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert values(got) == values(want)


def test_flagship(spark):
    assert catalog.flagship(spark, DIR).count() > 0


def test_filters_reach_the_scan(spark):
    from turnmill.operators.search import SearchFilters, search_entries
    from turnmill.operators.tables import entries

    plan = search_entries(entries(spark, DIR), SearchFilters(content_min=5)).select("id")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
