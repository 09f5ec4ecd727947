"""Operator 11 against plain eigenvectors of the covariance."""

import math

import numpy as np
import pytest

from filamenta.llm import whitening
from filamenta.llm.queries import QUERIES

INF = float("inf")


def plain(rows, components=4):
    """{(vec_id, component)}: n, deviation, whitened, explained, by numpy on the whole matrix."""
    usable = [(i, [math.floor(256 * float(np.float64(c))) for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = np.array(sorted({tuple(x) for _, x in usable}))
    n, sums = len(fit), [int(s) for s in fit.astype(object).sum(0)]
    centred = fit - np.array([s / n for s in sums])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    out = {}
    for i, x in usable:
        for k in range(min(components, fit.shape[1])):
            z = (x - np.array(sums) / n) @ axes[:, k] / math.sqrt(values[k])
            out[i, k + 1] = n, sum((n * a - s) ** 2 for a, s in zip(x, sums)), z, values[k] / values.sum()
    return out


def same(got, want):
    assert {(r["vec_id"], r["component"]) for r in got} == set(want)
    sign = {}
    for r in got:
        n, deviation, z, share = want[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        if abs(z) > 1e-3:
            s = sign.setdefault(r["component"], np.sign(z) * np.sign(r["whitened"]))
            assert abs(r["whitened"] * s - z) < 1e-8 * max(1, abs(z))
        assert abs(r["explained"] - share) < 1e-9 and r["identity_error"] < 1e-9


@pytest.mark.parametrize("d, n", [(64, 300), (3, 30)])
def test_components_equal_plain_ones(spark, d, n):
    rng = np.random.default_rng(d)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(d) * np.linspace(1, 2, d)]) for i in range(n)]
    rows += [(n, rows[0][1]), (n + 1, rows[1][1]), (n + 2, None), (n + 3, [None] * d), (n + 4, [INF] * d), (n + 5, [float("nan")] * d), (n + 6, [])]
    df = spark.createDataFrame([(i, v, 1, "x", 0) for i, v in rows], "vec_id long, embedding array<float>, label int, x string, d int")
    same(whitening.whiten(df).collect(), plain(rows))


def test_query_equals_plain(spark, sf):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    same(QUERIES["op11_whitening"](spark, sf).collect(), plain(rows))


def test_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    of = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert of([]) == of([(1, None), (2, [INF])]) == []
    equal = of([(1, [1.0, 2.0]), (2, [1.0, 2.0]), (None, [1.0, 2.0])])
    assert len(equal) == 6 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in equal} == {(1, 0, None, 0.0, None)}
    line = of([(k, [float(k), 2.0 * k]) for k in range(5)] + [(9, [1.0]), (None, [1.0, 2.0])])
    assert {r["component"]: r["explained"] > 0.999 for r in line} == {1: True, 2: False} and all((r["whitened"] is None) == (r["component"] == 2) for r in line)
    assert {r["vec_id"] for r in line} == {0, 1, 2, 3, 4, None}
    far = of([(1, [1e30, 0.0]), (2, [-1e30, 1.0]), (3, [0.0, 0.5])])
    assert all(r["deviation"] is None and int(r["deviation_exact"]) > 1 << 63 for r in far if r["vec_id"] != 3)


def test_a_filter_damps_what_lies_in_its_interval():
    values = np.array([10.0, 8.0, 3.0, 2.0, 1.0])
    out = np.diag(whitening.filtered(lambda q: values[:, None] * q, np.eye(5), 1.0, 3.0, 10.0, 8))
    assert abs(out[0] - 1) < 1e-9 and np.abs(out[2:]).max() < 1e-5 < 0.1 < out[1] ** (1 / 8)
    assert 0 <= whitening.lower_bound(lambda q: values[:, None] * q, np.ones(5), 3) <= 1.0
