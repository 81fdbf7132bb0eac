"""Queries on rows as larger tables have them, against DuckDB."""

import duckdb
import pytest

from turnmill.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.fixture
def same_as_sql(spark, tmp_path):
    def check(name, **tables):
        con = duckdb.connect()
        for t, sql in tables.items():
            duckdb.sql(f"COPY ({sql}) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
        got = catalog.queries()[name](spark, str(tmp_path))
        order = ", ".join(sorted(got.columns))
        want = con.execute(f"SELECT {order} FROM ({catalog.oracle_sql()[name]})").fetchall()
        assert sorted(map(tuple, got.select(*sorted(got.columns)).collect())) == sorted(want)
        return want

    return check


def test_client_ips_of_many_users(same_as_sql):
    users = "CASE event_id // 2 % 6 WHEN 0 THEN 0 WHEN 1 THEN 65535 WHEN 2 THEN 65536 WHEN 3 THEN 89999 WHEN 4 THEN 16777215 ELSE 3000000000 END"
    rows = same_as_sql("client_ips", events=f"SELECT * REPLACE (CAST({users} AS BIGINT) AS user_id) FROM '{DIR}/events.parquet' WHERE event_id < 24")
    assert ("10.0.11718750.0", "10.0.11718750.*", 2) in rows and len(rows) == 7


def test_page_titles_with_numbers_like_years(same_as_sql):
    rows = same_as_sql("page_titles", documents=f"SELECT * REPLACE (doc_id + 1900 AS doc_id) FROM '{DIR}/documents.parquet'")
    assert len(rows) >= 200


def test_activity_stays_in_the_jvm(spark):
    from turnmill.operators.tables import as_requests
    from turnmill.streaming import run, visits

    plan = visits.activity_changes(as_requests(run.source(spark, f"{DIR}/events.parquet")))._jdf.queryExecution().analyzed().toString()
    assert "TransformWithState" not in plan and "Aggregate" in plan
