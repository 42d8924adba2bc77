"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

NAMES = sorted(n for n in entry.queries() if n in entry.oracle_sql() and not n.startswith("op"))


@pytest.fixture(scope="module")
def duck(smoke_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{smoke_dir}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def plain(df, cols):
    value = lambda x: None if x is None or x != x else float(x) if isinstance(x, float) else int(x) if getattr(getattr(x, "dtype", None), "kind", "") in "iu" and hasattr(x, "dtype") else x
    return sorted(repr([value(x) for x in row]) for row in df[cols].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, smoke_dir, duck, name):
    got, want = entry.queries()[name](spark, smoke_dir).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    assert plain(got, cols) == plain(want, cols)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_rows_only(spark, smoke_dir):
    assert entry.queries()["score_ml"](spark, smoke_dir).count() > 0
