"""Every query against its SQL in DuckDB."""

import os
from pathlib import Path

import duckdb
import pandas as pd
import pytest

from barsmith import plans

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = plans.oracle_sql()
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test data")


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]

    def norm(v):
        if pd.isna(v):
            return None
        if isinstance(v, (bool, str, pd.Timestamp)):
            return str(v)
        return round(float(v), 5) if hasattr(v, "__float__") else str(v)

    return sorted((tuple(map(norm, r)) for r in df.itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    want = duck.execute(SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    for a, b in zip(rows(got), rows(want), strict=True):
        assert a == pytest.approx(b, abs=2e-5, rel=1e-9, nan_ok=True) if all(not isinstance(x, str) and x is not None for x in a) else all(x == y or (isinstance(x, float) and isinstance(y, float) and abs(x - y) <= 2e-5 + 1e-9 * abs(y)) for x, y in zip(a, b, strict=True)), (a, b)
