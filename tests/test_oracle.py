"""Every registered gap query against its own DuckDB SQL on the smallest tables."""

import datetime
import math

import duckdb
import pytest

from lagscope.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_matches_sql(spark, duck, name):
    df = queries.queries()[name](spark, SF)
    rows = df.collect()
    if name not in oracle.SQL:
        assert rows
        return
    found = duck.execute(oracle.SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    key = sorted(df.columns)
    ours = sorted((tuple(plain(r[c]) for c in key) for r in rows), key=repr)
    theirs = sorted((tuple(plain(r[names.index(c)]) for c in key) for r in found.fetchall()), key=repr)
    assert ours == theirs
