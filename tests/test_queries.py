"""Every query with SQL against DuckDB on the smallest tables, and every other one for its columns."""

import datetime
import decimal
import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry


def text(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9) + 0.0)
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.fixture(scope="module")
def duck(small):
    c = duckdb.connect()
    for f in Path(small).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, duck, small, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(tuple(text(r[c]) for c in cols) for r in df.collect())
    cursor = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == cols
    assert got == sorted(tuple(text(r[names.index(c)]) for c in cols) for r in cursor.fetchall())


def test_entry_and_names(spark, small):
    assert entry.entry(spark).columns == ["customer", "nation", "orders", "total", "mean_price"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["p3_nodes"])
def test_other_data_queries_run_over_whole_tables(spark, small, name):
    assert entry.queries()[name](spark, small).count() > 0
