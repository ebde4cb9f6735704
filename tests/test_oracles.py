"""Every registered query of the cohort language against its SQL in DuckDB."""

import math

import duckdb
import pytest

from tessera import queries, tool_queries  # noqa: F401 registers more

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for name in "region nation customer supplier part orders lineitem events".split():
        con.sql(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "" if v is None else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_matches_sql(spark, duck, name):
    df, want = queries.QUERIES[name](spark, DATA), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())
