"""The queries that SQL can express, against their DuckDB SQL on whole tables."""

import duckdb
import pytest

from lagscope.llm import oracle, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_its_sql(spark, name):
    out = queries.queries()[name](spark, SF)
    columns = sorted(out.columns)
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    expected = con.sql(f"select {', '.join(columns)} from ({oracle.SQL[name].rstrip().rstrip(';')})").fetchall()
    assert sorted(tuple(r[c] for c in columns) for r in out.collect()) == sorted(expected)
