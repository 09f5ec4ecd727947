"""Curve fits in batches: against the rounds in Spark's expressions, and on degenerate curves."""

import random

from filamenta.operators import curves


def _curves(spark):
    rng = random.Random(4)
    rows = [(k, i / 20, 1 / (1 + (i / 20 / 0.4) ** (2 + k % 5)) + rng.gauss(0, 0.02)) for k in range(30) for i in range(1, 8 + k % 9)]
    return spark.createDataFrame(rows, "k long, s double, f double")


def test_batches_equal_the_rounds_in_expressions(spark):
    df = _curves(spark)
    for model, start in ((curves.butterworth, lambda x: (curves.middle(x), curves.F.lit(2.0))), (curves.fermi, lambda x: (curves.middle(x), curves.middle(x) / 5))):
        got = {r["k"]: r["m"] for r in curves.fitted(df, "k", "s", "f", model, start, "m").collect()}
        want = {r["k"]: r["m"] for r in curves.fitted(df, "k", "s", "f", lambda s, p, q: model(s, p, q), start, "m", rounds=60).collect()}
        assert len(got) == 30
        for k, w in want.items():
            assert abs(got[k]["e"] - w["e"]) < 1e-9 and abs(got[k]["p"] - w["p"]) < 1e-5 * w["p"], (k, got[k], w)


def test_a_curve_that_says_nothing_stops_no_other(spark):
    rows = [(1, 0.0, 1.0)] * 4 + [(2, 0.1, 0.9), (2, 0.2, 0.5), (2, 0.3, 0.1), (2, 0.4, 0.0)] + [(3, 0.1, 1.0)]
    got = {r["k"]: r for r in curves.falling_fits(spark.createDataFrame(rows, "k long, s double, f double"), "k", "s", "f").collect()}
    assert (got[1]["model"], got[1]["error"]) == ("butterworth", 0.0)
    assert got[2]["error"] < 0.01 and got[3]["model"] is None and got[3]["p"] is None
