"""Sources, streams, and properties of the angle functions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filamenta.functions import angles
from filamenta.operators.grouping import packed_runs
from filamenta.sources.star import loops, read_star, write_star
from filamenta.streaming import acquisition_groups

STAR = """data_optics

loop_
_rlnOpticsGroup #1
_rlnVoltage #2
1 300.0

data_particles

loop_
_rlnImageName #1
_rlnClassNumber #2
_rlnAnglePsi #3
000001@a.mrcs 2 10.5
000002@a.mrcs 1 -3
"""


def test_star_round_trip(spark, tmp_path):
    (tmp_path / "a.star").write_text(STAR)
    df = read_star(spark, f"file://{tmp_path}/a.star")
    assert [tuple(r) for r in df.orderBy("rid").collect()] == [(0, "000001@a.mrcs", 2, 10.5), (1, "000002@a.mrcs", 1, -3.0)]
    assert read_star(spark, f"file://{tmp_path}/a.star", "optics").count() == 1
    write_star(df, f"file://{tmp_path}/out")
    text = "\n".join(p.read_text() for d in sorted((tmp_path / "out").iterdir()) for p in sorted(d.glob("part-*")))
    block, columns, rows = next(loops(text))
    assert block == "particles" and columns == ["rlnImageName", "rlnClassNumber", "rlnAnglePsi"] and rows[0][1:] == ["2", "10.5"]
    with pytest.raises(ValueError):
        read_star(spark, f"file://{tmp_path}/a.star", "movies")


def test_stream_and_batch_agree(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    (tmp_path / "in").mkdir()
    batch.write.parquet(f"file://{tmp_path}/in/x")
    stream = spark.readStream.schema(batch.schema).parquet(f"file://{tmp_path}/in/x")
    q = acquisition_groups(stream).writeStream.outputMode("complete").format("memory").queryName("groups").start()
    try:
        q.processAllAvailable()
        got = {tuple(r)[:3] for r in spark.table("groups").collect()}
    finally:
        q.stop()
    assert got == {tuple(r)[:3] for r in acquisition_groups(batch).collect()}


def test_euler_round_trip(spark):
    rows = [(a, b, c) for a in (-170.0, -20.0, 33.0) for b in (5.0, 90.0, 170.0) for c in (-100.0, 0.0, 77.0)]
    df = spark.createDataFrame(rows, "rot double, tilt double, psi double")
    q = angles.euler_to_quaternion(F.col("rot"), F.col("tilt"), F.col("psi"))
    named = df.select("*", *[c.alias(n) for c, n in zip(q, "wxyz")])
    back = angles.quaternion_to_euler(*[F.col(n) for n in "wxyz"])
    worst = named.select(*[F.max(F.abs(angles.wrap(F.col(n) - e))).alias(n) for n, e in zip(("rot", "tilt", "psi"), back)]).first()
    assert max(worst) < 1e-9


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(1, 5), min_size=1, max_size=30), st.integers(1, 8))
def test_packed_runs_are_gapless_and_ordered(counts, size):
    groups = packed_runs(list(enumerate(counts)), size)
    assert groups == sorted(groups) and groups[0] == 0
    assert set(groups) == set(range(groups[-1] + 1))
