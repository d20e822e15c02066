"""Queries against their SQL at the smallest size."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from lineloom.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(frame):
    def one(v):
        if v is None or type(v).__name__ in ("NaTType", "NAType") or isinstance(v, float) and math.isnan(v):
            return None
        v = v.item() if hasattr(v, "item") else v
        return round(float(v), 6) if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    columns = sorted(frame.columns)
    return columns, sorted(repr([one(v) for v in row]) for row in frame[columns].astype(object).values.tolist())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, duck, name):
    assert plain(registry.queries()[name](spark, SF).toPandas()) == plain(duck.execute(registry.oracle_sql()[name]).df())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns == ["item_id", "doc_id", "citation", "confidence"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
