"""Queries that SQL can express give DuckDB's rows."""

import glob
import os

import duckdb
import pytest

from cairnfield.llm import queries

SF = "/root/testdata/sf0.001"


def bag(df):
    df = df[sorted(df.columns)]
    return sorted(repr(tuple(None if v is None or v != v else round(v, 9) if isinstance(v, float) else v for v in row)) for row in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    ours, theirs = queries.QUERIES[name](spark, SF).toPandas(), con.sql(queries.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns) and bag(ours) == bag(theirs) and len(ours)
