"""Queries against their SQL on rows at the edges that the small tables don't reach."""

import datetime

import duckdb
import pytest

from filamenta.plans import QUERIES, SQL

from .test_oracles import ordered, same


@pytest.fixture
def compared(spark, tmp_path):
    """compared(name, events): the query's rows, after they were held against those of its SQL; events: rows (event_id, user_id, event_type, seconds, value)."""

    def run(name, events):
        first = datetime.datetime(2024, 1, 1)
        rows = [(i, first + datetime.timedelta(seconds=t), m, k, float(v), "{}") for i, m, k, t, v in events]
        spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").write.parquet(f"{tmp_path}/events.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * REPLACE (CAST(ts AS TIMESTAMP) AS ts) FROM '{tmp_path}/events.parquet/*.parquet'")
        got = QUERIES[name](spark, str(tmp_path))
        columns = sorted(got.columns)
        want = con.execute(f"SELECT {', '.join(columns)} FROM ({SQL[name]})").fetchall()
        rows = [tuple(r) for r in got.select(*columns).collect()]
        assert len(rows) == len(want) > 0
        for a, b in zip(ordered(rows), ordered(want)):
            assert all(map(same, a, b)), (columns, a, b)
        return [dict(zip(columns, r)) for r in ordered(rows)]

    return run


def test_bytes_beyond_gigabytes(compared):
    rows = compared("bytes_in_units", [(k, 0, "view", 0, 1) for k in (1, 20, 500, 13000, 396324, 396325, 40_000_000)])
    assert [r["unit"] for r in rows] == ["kB", "kB", "MB", "GB", "GB", "GB", "GB"]
    assert rows[-1]["value"] == 7 * 40_000_000**2 / 2**30




def _quarters():
    """Every value of a step whose partner, 2.5 more, lies 90 degrees on; a filament each, and one of near segments."""
    rows = []
    for k in range(4000):
        rows += [(10 * k, k, "view", 0, round(k * 0.07, 2)), (10 * k + 5, k, "view", 90_000, round(k * 0.07 + 2.5, 2))]
    return rows + [(100_001, 5000, "view", 0, 3.0), (100_006, 5000, "view", 60_000, 3.5)]


def test_pair_distances_at_a_quarter_turn(compared):
    assert 5000 in [r["mic"] for r in compared("pair_distances", _quarters())]


def test_pair_distance_histogram_at_a_quarter_turn(compared):
    assert compared("pair_distance_histogram", _quarters())[0]["bin"] == 0


def test_twist_histogram_at_a_quarter_turn(compared):
    assert len(compared("twist_histogram", _quarters())) == 40
