"""Each state query against its SQL in another engine, over the smallest tables."""

import duckdb
import pytest

from millrace.plans import state_queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(state_queries.queries()))
def test_query(spark, duck, name):
    df = state_queries.queries()[name](spark, SF)
    other = duck.sql(state_queries.oracle_sql()[name])
    assert sorted(df.columns) == sorted(other.columns)
    want = [tuple(row) for row in other.select(*(f'"{c}"' for c in df.columns)).fetchall()]
    assert sorted(map(repr, map(tuple, df.collect()))) == sorted(map(repr, want))
