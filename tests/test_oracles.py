"""Every registered query that has SQL, against DuckDB on the same tables."""

import os

import duckdb
import pytest

from filamenta.plans import QUERIES, SQL


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    return con


def same(a, b) -> bool:
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (abs(a - b) <= 1e-9 * max(1.0, abs(a)) or a != a and b != b)
    return a == b


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, round(x, 2) if isinstance(x, float) else x if not isinstance(x, (int, bool)) else int(x)) if not isinstance(x, str) else (False, x) for x in r))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, sf, duck, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
    rows = [tuple(r) for r in got.select(*columns).collect()]
    assert len(rows) == len(want) > 0
    for a, b in zip(ordered(rows), ordered(want)):
        assert all(map(same, a, b)), (columns, a, b)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0
