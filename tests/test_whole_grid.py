"""Operators that once did less than their whole job."""

from filamenta import plans
from filamenta.operators import filaments, joins


def test_best_slope_is_found_on_the_whole_grid(spark):
    slope, tracks = -1.1 + 347 * (2.2 / 1200), [97.0 * k for k in range(40)]
    rows = [(k, 1, t, (slope * t + 20) % 360, t % 7, 0.0) for k, t in enumerate(tracks)]
    best = filaments.best_slope(spark.createDataFrame(rows, "rid long, mic long, track double, rot double, x double, y double"), ["mic"]).first()
    assert abs(best["slope"] - slope) < 1e-9 and best["variance"] < 1e-6
    assert plans.QUERIES["hom_fit_all_slopes"](spark, "/root/testdata/sf0.001").columns == ["mic", "slope", "variance"]


def test_all_rows_are_asked_and_candidates(spark):
    rows = [(1, "m", 0.0, 0.0), (3, "m", 1.0, 1.0), (4, "m", 50.0, 50.0), (6, "m", 51.5, 50.0), (8, "m", 90.0, 0.0), (9, "n", 90.0, 0.0)]
    d = spark.createDataFrame(rows, "rid long, mic string, x double, y double")
    assert {r["rid"] for r in joins.near_semi(d, d, ["mic"], "x", "y", 2.0, "rid", own=False).collect()} == {1, 3, 4, 6}
    assert joins.near_semi(d, d, ["mic"], "x", "y", 2.0, "rid").count() == 6
