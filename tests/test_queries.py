"""Every registered query with SQL against DuckDB on the same tables, and rows for the others."""

import os

import duckdb
import numpy as np
import pandas as pd
import pytest

from tidemill.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return c


def rows(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)]
    cells = [[None if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and np.isnan(x)) else str(x) if isinstance(x, pd.Timestamp) else round(float(x), 5) + 0.0 if isinstance(x, (int, float, np.number)) and not isinstance(x, bool) else str(x) for x in r] for r in df.astype(object).to_numpy().tolist()]
    return sorted(cells, key=str)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_matches_duckdb(spark, con, sf_dir, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    want = con.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b)
    for x, y in zip(a, b):
        for u, v in zip(x, y):
            assert u == v or (isinstance(u, float) and isinstance(v, float) and abs(u - v) <= 2e-5 * max(1, abs(u))), (name, x, y)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_has_rows(spark, sf_dir, name):
    assert registry.queries()[name](spark, sf_dir).count() > 0
