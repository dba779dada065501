"""Every query with SQL gives the rows that DuckDB gives."""

import glob
import os

import duckdb
import pandas as pd
import pytest

from cairnfield import contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


def bag(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or isinstance(v, float) and v != v:
            return None
        return round(v, 6) if isinstance(v, float) else v

    df = df[sorted(df.columns)]
    return sorted(repr(tuple(map(plain, row))) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(contract.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    ours, theirs = contract.QUERIES[name](spark, SF).toPandas(), duck.sql(contract.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert bag(ours) == bag(theirs)


@pytest.mark.parametrize("name", sorted(set(contract.QUERIES) - set(contract.ORACLE_SQL)))
def test_rows_without_sql(spark, name):
    n = contract.event_points(spark, SF).count()
    assert sum(r["n"] for r in contract.QUERIES[name](spark, SF).collect()) == n


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
