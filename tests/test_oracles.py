"""Every registered query of the spectral engine against its DuckDB twin, at the smallest scale."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from prismflow.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    ours = QUERIES[name](spark, SF).toPandas()
    if name not in ORACLES:
        assert len(ours)
        return
    twin = duck.sql(ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert sorted(twin.columns) == columns
    a, b = (tidy_rows(df[columns]) for df in (ours, twin))
    assert a == b


def tidy_rows(df):
    rows = [tuple(None if pd.isna(v) else v for v in row) for row in df.itertuples(index=False)]
    return sorted(rows, key=lambda row: tuple((v is None, 0 if v is None else v) for v in row))


def test_entry(spark):
    assert entry.entry(spark).columns == ["source", "feature_id", "value"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
