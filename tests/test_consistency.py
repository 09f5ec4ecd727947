"""The chain of helical consistency and the option chains, on small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from filamenta.operators import consistency as K


def _segments(spark, filaments):
    """Rows of filaments (mic, tube, [(track, rot)])."""
    rows = [(mic, tube, track, rot) for mic, tube, points in filaments for track, rot in points]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "rid long, mic string, tube int, track double, rot double")


def test_lines_of_one_slope_have_small_errors_up_and_down(spark):
    up = [(10.0 * k, (0.22 * 10 * k + 20) % 180) for k in range(30)]
    down = [(10.0 * k, (-0.22 * 10 * k + 70) % 180) for k in range(40)]
    df = _segments(spark, [("a", 1, up), ("b", 2, down), ("c", 3, up[:24])])
    rows, filaments, slope, period = K.segment_consistency(df, ["mic", "tube"])
    assert period == 180.0 and slope == pytest.approx(0.22, abs=0.001)
    found = {r["mic"]: r for r in filaments.collect()}
    assert set(found) == {"a", "b"} and found["a"]["slope"] > 0 > found["b"]["slope"]
    assert all(r["error"] / r["segments"] < 1 for r in found.values()) and sorted(r["place"] for r in found.values()) == [1, 2]
    got = rows.collect()
    assert len(got) == 94 and {r["filament"] for r in got} == {0, 1, 2}
    assert all(r["good"] == r["good_segment"] == 0 for r in got if r["mic"] == "c")
    assert all(0 <= r["good_segment"] < 2 for r in got)


def test_empty_short_null_and_equal_angles(spark):
    empty = _segments(spark, [])
    rows, filaments, slope, period = K.segment_consistency(empty, ["mic", "tube"])
    assert rows.count() == filaments.count() == 0 and slope is period is None
    short = _segments(spark, [("a", 1, [(1.0, 2.0)] * 24)])
    rows, filaments, slope, _ = K.segment_consistency(short, ["mic", "tube"])
    assert slope is None and filaments.count() == 0 and {r["good"] for r in rows.collect()} == {0.0}
    same = _segments(spark, [("a", 1, [(float(k), 5.0) for k in range(25)] + [(None, 5.0), (3.0, None)])])
    rows, filaments, slope, period = K.segment_consistency(same, ["mic", "tube"])
    assert period == 180.0 and slope == pytest.approx(0.0, abs=0.002) and filaments.first()["segments"] == 25
    assert [r["good_segment"] for r in rows.orderBy("rid").collect()][25:] == [None, None]


def test_profile_finds_the_bells_of_which_rows_are_made(spark):
    density = lambda x: 2000 * math.exp(-0.5 * (x / 6) ** 2) + 300 * math.exp(-0.5 * (x / 40) ** 2)
    places = [((k + 0.5) / 20, round(density((k + 0.5) / 20) / 4)) for k in range(1800)]
    df = spark.createDataFrame(places, "e double, n int").select("e", F.explode(F.sequence(F.lit(1), "n"))).select("e")
    fit = K.error_profile(df, "e", 180.0)
    assert fit["peak_deviation"] == pytest.approx(6, rel=0.1) and fit["tail_deviation"] == pytest.approx(40, rel=0.1)
    assert fit["peak"] / fit["tail"] == pytest.approx(2000 / 300, rel=0.15)
    bins = K.error_histogram(df, "e", 90.0).collect()
    assert sum(r["n"] for r in bins) == sum(n for _, n in places)
    assert K.error_profile(df.where("e < 0.05"), "e", 180.0)["peak_deviation"] == 0.0
    assert K.error_profile(df.where("false"), "e", 180.0) == dict.fromkeys(("peak", "peak_deviation", "tail", "tail_deviation"), 0.0)


def test_named_segments_number_micrographs_in_order(spark):
    df = spark.createDataFrame([(7, "2@b.mrc"), (3, "1@b.mrc"), (9, "1@a.mrc")], "rid long, rlnImageName string")
    got = {r["rid"]: (r["part"], r["micrograph"], r["micrograph_id"]) for r in K.named_segments(df, "rid").collect()}
    assert got == {3: (0, "b.mrc", 0), 7: (1, "b.mrc", 0), 9: (2, "a.mrc", 1)}


def test_quantiles_are_exact(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 9, 3)], "v double")
    assert K.quantile(df, "v", 0.5) == 4.0 and K.quantile(df, "v", 1.0) == 9.0 and K.quantile(df.where("v > 10"), "v", 0.5) is None
    assert K.quantile(df.withColumn("v", F.lit(2.0)), "v", 0.25) == 2.0
