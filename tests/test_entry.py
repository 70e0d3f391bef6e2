"""The driver contract: every query runs on the smallest tables and agrees with its SQL."""

import __spark_entry__ as contract
import duckdb
import pytest

from plexspark.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def test_entry(spark):
    assert contract.entry(spark).columns == ["id", "depth"]
    assert set(SQL) <= set(QUERIES) <= set(contract.queries()) and set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = contract.queries()[name](spark, SF)
    cols = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in got.select(cols).collect()))) == sorted(map(str, want))


def test_no_query_is_restricted_to_some_lines():
    assert not [name for name, sql in SQL.items() if "l_returnflag" in sql or "l_quantity >=" in sql]
