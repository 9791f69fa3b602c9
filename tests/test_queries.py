"""Every registered query with SQL against that SQL."""

import os

import duckdb
import numpy as np
import pytest

import __spark_entry__ as entry
from depscope.queries import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*.parquet' if os.path.isdir(path) else path}')")
    return con


def same(got, want):
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got) == len(want)
    frames = []
    for df in (got, want):
        df = df[columns].copy()
        for c in columns:
            df[c] = df[c].round(5) if df[c].dtype.kind == "f" else df[c].astype(str) if df[c].dtype == object else df[c]
        frames.append(df.sort_values(columns).reset_index(drop=True))
    for c in columns:
        a, b = frames[0][c], frames[1][c]
        assert np.allclose(a.astype(float), b.astype(float), atol=2e-5, equal_nan=True) if a.dtype.kind == "f" else (a == b).all(), c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, sql, name):
    same(QUERIES[name](spark, sf_dir).toPandas(), sql.execute(ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"generate_syn"}))
def test_without_sql(spark, sf_dir, name):
    assert QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert set(ORACLES) <= set(entry.oracle_sql()) <= set(entry.queries())
