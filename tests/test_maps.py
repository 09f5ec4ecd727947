"""Local measures, transforms and curve fits against plain arrays."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from filamenta.operators import curves, fourier, local, windows


def voxel_rows(cubes, axes="zyx"):
    return [(m, *map(int, at), float(c[at])) for m, c in cubes.items() for at in np.ndindex(c.shape)]


def test_transform_equals_numpy_and_comes_back(spark):
    rng = np.random.default_rng(1)
    cubes = {m: rng.standard_normal((3, 4, 5)) for m in (1, 2)}
    sizes = {"z": 3, "y": 4, "x": 5}
    df = spark.createDataFrame([(*r, 0.0) for r in voxel_rows(cubes)], "map long, z int, y int, x int, re double, im double")
    there = fourier.transformed(df, ["map"], sizes)
    for r in there.collect():
        want = np.fft.fftn(cubes[r["map"]])[r["z"], r["y"], r["x"]]
        assert abs(complex(r["re"], r["im"]) - want) < 1e-9
    for r in fourier.transformed(there, ["map"], sizes, inverse=True).collect():
        assert abs(r["re"] - cubes[r["map"]][r["z"], r["y"], r["x"]]) < 1e-9 > abs(r["im"])
    mixed = fourier.transformed(fourier.phases_randomised(there, ["map"], sizes, 1), ["map"], sizes, inverse=True).collect()
    assert max(abs(r["im"]) for r in mixed) < 1e-9  # the map stays real
    power = {m: sum(r["re"] ** 2 for r in mixed if r["map"] == m) for m in cubes}
    assert all(abs(power[m] - (c**2).sum()) < 1e-9 for m, c in cubes.items()) and max(abs(r["re"] - cubes[r["map"]][r["z"], r["y"], r["x"]]) for r in mixed) > 0.1


@pytest.mark.parametrize("width", [0, 1.0, 2.5, 4])
def test_soft_mask_is_that_of_exact_distances(spark, width):
    rng = np.random.default_rng(2)
    cube = (rng.random((7, 6, 5)) > 0.97).astype(float)
    df = spark.createDataFrame(voxel_rows({1: cube, 2: np.zeros((2, 2, 2))}), "map long, z int, y int, x int, v double")
    inside = np.argwhere(cube > 0)
    for r in local.soft_mask(df, "map", ["z", "y", "x"], F.col("v") > 0, width).collect():
        d = math.sqrt(min(((inside - [r["z"], r["y"], r["x"]]) ** 2).sum(1))) if r["map"] == 1 else math.inf
        want = 1.0 if d == 0 else (math.cos(d / width * math.pi / 2) + 1) / 2 if d <= width else 0.0
        assert abs(r["mask"] - want) < 1e-12


def test_structural_similarity_of_windows(spark):
    rng = np.random.default_rng(3)
    a, b = rng.random((2, 10, 9))
    rows = [(1, y, x, float(a[y, x]), float(b[y, x])) for y in range(10) for x in range(9)] + [(2, y, x, 1.0, 1.0) for y in range(8) for x in range(8)] + [(3, 0, x, float(x), 0.0) for x in range(8)]
    got = {r["k"]: r["ssim"] for r in local.structural_similarity(spark.createDataFrame(rows, "k long, y int, x int, a double, b double"), "k", ["y", "x"]).collect()}
    span, values = max(np.ptp(a), np.ptp(b)), []
    for y in range(4):
        for x in range(3):
            p, q = a[y : y + 7, x : x + 7].ravel(), b[y : y + 7, x : x + 7].ravel()
            c, v = np.cov(p, q), ((0.01 * span) ** 2, (0.03 * span) ** 2)
            values.append((2 * p.mean() * q.mean() + v[0]) * (2 * c[0, 1] + v[1]) / ((p.mean() ** 2 + q.mean() ** 2 + v[0]) * (c[0, 0] + c[1, 1] + v[1])))
    assert abs(got[1] - np.mean(values)) < 1e-9 and got[2] == got[3] == 0.0


def test_fits_find_the_curves_they_were_made_from(spark):
    s = np.linspace(0, 1, 40)
    made = {1: 1 / (1 + (s / 0.3) ** 3.5), 2: (math.exp(-4) + 1) / (np.exp((s - 0.4) / 0.1) + 1)}
    rows = [(k, float(x), float(y)) for k, f in made.items() for x, y in zip(s, f)] + [(1, 2.0, None), (1, 3.0, float("nan")), (1, 4.0, 7.0), (3, 0.0, 1.0), (3, 1.0, 0.5)]
    got = {r["k"]: r for r in curves.falling_fits(spark.createDataFrame(rows, "k long, s double, f double"), "k", "s", "f").collect()}
    assert (got[1]["model"], got[2]["model"], got[3]["model"]) == ("butterworth", "fermi", None)
    assert np.allclose([got[1]["p"], got[1]["q"], got[2]["p"], got[2]["q"]], [0.3, 3.5, 0.4, 0.1], atol=1e-8) and got[1]["error"] < 1e-15
    mean = spark.createDataFrame([(0.0, 1.0)], "a double, b double").select(curves.area(F.lit("butterworth"), F.lit(0.3), F.lit(3.5), F.col("a"), F.col("b"))).first()[0]
    x = np.linspace(0, 1, 500)
    assert abs(mean - np.trapezoid(1 / (1 + (x / 0.3) ** 3.5), x)) < 1e-9


def test_windows_are_cut_across_tiles_and_edges(spark):
    rng = np.random.default_rng(4)
    mics = {"a": rng.random((11, 13)), "b": rng.random((6, 5))}
    pixels = spark.createDataFrame([(m, y, x, float(c[y, x])) for m, c in mics.items() for y, x in np.ndindex(c.shape)], "mic string, y int, x int, v double")
    places = [(k, m, y, x) for k, (m, y, x) in enumerate([("a", 5.4, 6.5), ("a", 0.0, 0.0), ("a", 10.0, 12.0), ("b", 3.0, 2.0), ("b", 50.0, 50.0), ("none", 1.0, 1.0), ("a", None, 1.0)])]
    df = spark.createDataFrame(places, "rid long, mic string, y double, x double")
    for tile in (4, 64):
        for fill in ("mean", "zero"):
            got = {r["rid"]: r for r in windows.windows(df, windows.tiles(pixels, "mic", tile), "mic", F.col("y"), F.col("x"), 5, tile=tile, fill=fill).collect()}
            for k, m, y, x in places:
                if k >= 4:
                    assert (got[k]["inside"], got[k]["values"]) == (0, None)
                    continue
                c, y0, x0 = mics[m], round(y) - 2, round(x) - 2
                want = np.array([[c[i, j] if 0 <= i < c.shape[0] and 0 <= j < c.shape[1] else np.nan for j in range(x0, x0 + 5)] for i in range(y0, y0 + 5)])
                inside = ~np.isnan(want)
                want[~inside] = want[inside].mean() if fill == "mean" else 0
                assert got[k]["inside"] == inside.sum() and np.allclose(got[k]["values"], want.ravel())
