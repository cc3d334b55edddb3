"""Every query with SQL gives that SQL's rows."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from rastrel import queries as grids

SF = "/root/testdata/sf0.001"


def plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    v = float(v)
    return None if math.isnan(v) else round(v, 9) + 0.0


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(grids.ORACLES))
def test_same_rows(spark, sql, name):
    df = grids.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    want = sql.sql("SELECT " + ", ".join(f'"{c}"' for c in columns) + f" FROM ({grids.ORACLES[name]})").fetchall()
    got = df.select(columns).collect()
    key = lambda rows: sorted((tuple(map(plain, r)) for r in rows), key=str)
    assert key(got) == key(want)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
