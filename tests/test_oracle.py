"""Every query that SQL can express, against DuckDB on the smallest tables."""

from __future__ import annotations

import duckdb
import pandas as pd
import pytest

from strandlake.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(df: pd.DataFrame) -> list[tuple]:
    """Rows in an order that other columns than those of floats decide first, so that rows pair up."""

    def cell(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):  # whole numbers are alike whether a column has nulls, and so is one of floats, or not
            v = round(float(v), 4)
            return str(int(v)) if abs(v) < 1e15 and v == int(v) else v
        return str(v)

    rows = [tuple(cell(v) for v in row) for row in df[sorted(df.columns)].astype(object).itertuples(index=False)]
    return sorted(rows, key=lambda r: (repr([v for v in r if not isinstance(v, float)]), repr(r)))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, sf_dir, name):
    got, want = registry.queries()[name](spark, sf_dir).toPandas(), duck.execute(registry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = plain(got), plain(want)
    assert len(a) == len(b) and len(a) > 0
    for x, y in zip(a, b, strict=True):
        for u, v in zip(x, y, strict=True):
            assert u == v or (u is not None and v is not None and abs(float(u) - float(v)) < 2e-4), (x, y)
