"""Every registered query of the log engine against its DuckDB counterpart."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry_module
from kelpline.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if isinstance(v, (list, tuple)) or (hasattr(v, "tolist") and hasattr(v, "__len__")):
        return str([cell(x) for x in v])
    if v is None or v is pd.NaT or v is pd.NA:
        return "NULL"
    if hasattr(v, "as_tuple"):
        v = float(v)
    if isinstance(v, float):
        return "NULL" if v != v else repr(int(v)) if v == int(v) and abs(v) < 1e15 else f"{v:.9g}"
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else str(v)


def rows(df):
    columns = sorted(df.columns)
    return columns, sorted(zip(*[[cell(v) for v in df[c].tolist()] for c in columns], strict=True))


@pytest.fixture(scope="session")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, sf, duck, name):
    assert rows(registry.QUERIES[name](spark, sf).toPandas()) == rows(duck.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    assert entry_module.entry(spark).count() > 0


def test_queries_without_oracle_run(spark, sf):
    for name in set(registry.QUERIES) - set(registry.ORACLES):
        assert registry.QUERIES[name](spark, sf).count() > 0, name
