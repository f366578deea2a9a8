"""Every registered query against its SQL twin on the smallest test data, where that is there."""

import os

import pytest

import __spark_entry__ as entry

DATA = os.environ.get("MILLRACE_TESTDATA", "/root/testdata/sf0.001")
SQL = {k: v for k, v in entry.oracle_sql().items()}


def cell(x):
    if x is None:
        return ""
    if isinstance(x, float):
        return "" if x != x else f"{x:.9g}"
    return str(x)


def table(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test data")
    con = duckdb.connect()
    for f in os.listdir(DATA):
        if f.endswith(".parquet"):
            con.execute(f"create view {f[:-8]} as select * from '{DATA}/{f}'")
    return con


def test_every_sql_has_its_query():
    assert set(SQL) <= set(entry.queries()) and "freq_day" in SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    duck.execute(SQL[name])
    columns = [c[0] for c in duck.description]
    assert table(df.collect(), df.columns) == table(duck.fetchall(), columns)
