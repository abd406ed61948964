"""Every query that SQL can express against DuckDB, and the others for a stable schema, on the smallest tables."""

import datetime
import glob
import os

import pytest

duckdb = pytest.importorskip("duckdb")

import __spark_entry__  # noqa: E402
from thalweg.plans import registry  # noqa: E402

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else float(f"{v:.9g}")
    if isinstance(v, datetime.date) and not isinstance(v, datetime.datetime):
        return str(v)
    return float(v) if type(v).__name__ == "Decimal" else v


def rows_of(rows, order):
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    result = duck.execute(registry.SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    names = sorted(columns)
    assert rows_of(df.collect(), [df.columns.index(c) for c in names]) == rows_of(result.fetchall(), [columns.index(c) for c in names])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(spark, name):
    df = registry.QUERIES[name](spark, SF)
    assert df.columns and df.count() >= 0


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.SQL) <= set(__spark_entry__.oracle_sql()) and set(registry.QUERIES) <= set(__spark_entry__.queries())
