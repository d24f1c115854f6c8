"""Every registered query with SQL gives what DuckDB gives, at the smallest size."""

import duckdb
import pytest

import __spark_entry__

D = "/root/testdata/sf0.001"
SQL = __spark_entry__.oracle_sql()


def plain(v):
    return round(v, 5) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(n for n in SQL if not n.startswith("op")))
def test_like_sql(spark, name):
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("documents", "embeddings", "pages", "benchmark", "events"):
        con.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    df = __spark_entry__.queries()[name](spark, D)
    names = sorted(df.columns)
    want = con.sql(SQL[name])
    assert sorted(want.columns) == names
    at = [want.columns.index(c) for c in names]
    rows = sorted((tuple(plain(r[c]) for c in names) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)
