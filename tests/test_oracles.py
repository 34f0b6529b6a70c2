"""Every query that has SQL gives the rows that DuckDB gives for it."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from storyloom.plans import catalog


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{sf}/{f}')")
    return con


def plain(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and np.isnan(v):
        return None
    if isinstance(v, (float, np.floating)) and float(v).is_integer():
        return str(int(v))  # pandas makes whole numbers with a null among them fractions
    return repr(round(float(v), 6)) if isinstance(v, (float, np.floating)) else str(list(v)) if isinstance(v, (list, np.ndarray)) else str(v)


def rows(frame):
    names = sorted(frame.columns)
    return names, sorted(map(str, ([plain(v) for v in r] for r in frame[names].astype(object).itertuples(index=False))))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_against_sql(spark, sf, duck, name):
    assert rows(catalog.QUERIES[name](spark, sf).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).fetchdf())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_other_queries_run(spark, sf, name):
    df = catalog.QUERIES[name](spark, sf)
    assert df.count() > 0 and sorted(map(str, df.collect())) == sorted(map(str, catalog.QUERIES[name](spark, sf).collect()))


def test_scans_are_pruned_and_filters_pushed(spark, sf):
    text = catalog.agg1_persons(spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    schema = next(x for x in text.splitlines() if x.startswith("ReadSchema"))
    assert "l_partkey" in schema and "l_extendedprice" not in schema
    text = catalog.flagship_characters(spark, sf)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "TakeOrderedAndProject" in text
