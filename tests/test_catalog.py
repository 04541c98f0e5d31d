"""Every query with SQL against DuckDB on the smallest tables; the others run and keep their schema."""

import glob
import math
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from inkwell.plans import catalog


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    yield con
    con.close()


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA:
        return None
    if hasattr(v, "tolist"):
        v = v.tolist()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, pd.Timestamp) else v


def rows(df):
    return sorted((tuple(map(plain, r)) for r in df[sorted(df.columns)].itertuples(index=False, name=None)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, small, name):
    got = catalog.QUERIES[name](spark, small).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows(got) == rows(duck.execute(catalog.ORACLE_SQL[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).schema == __spark_entry__.entry(spark).schema
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
