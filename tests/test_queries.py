"""Registered queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from seqspark.plans import queries

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def rows(columns, records):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(str([r[i] for i in order]) for r in records)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_duckdb(spark, duck, name):
    df = queries.QUERIES[name](spark, DATA)
    want = duck.execute(queries.ORACLE[name])
    columns = [c[0] for c in want.description]
    assert sorted(df.columns) == sorted(columns)
    assert rows(df.columns, map(tuple, df.collect())) == rows(columns, want.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["seq_id", "tis", "score"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
