"""Point groups, conversion, structured exports, averages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from filamenta.functions import angles, symmetry
from filamenta.operators.averages import average_rotation, elbow
from filamenta.operators.conventions import convention, rotation_vector_to_euler, to_star
from filamenta.sources.exports import read_export, read_tables


@pytest.mark.parametrize("symbol, size", [("C1", 1), ("C5", 5), ("D1", 2), ("D7", 14), ("T", 12), ("O", 24), ("I", 60), ("I1", 60), ("I2", 60), ("I3", 60), ("i_3z2x", 60), ("I_3z2y", 60)])
def test_groups_are_closed(symbol, size):
    matrices = np.array([symmetry.matrix(q) for q in symmetry.group(symbol)])
    assert matrices.shape == (size, 3, 3)
    assert np.allclose(matrices @ matrices.transpose(0, 2, 1), np.eye(3))
    products = (matrices[:, None] @ matrices[None]).reshape(-1, 1, 9)
    assert np.abs(products - matrices.reshape(1, -1, 9)).max(2).min(1).max() < 1e-6


def test_setting_change_maps_one_group_to_another():
    change = np.array(symmetry.matrix(symmetry.setting_change("I1", "I4")))
    moved = change @ np.array([symmetry.matrix(q) for q in symmetry.group("I1")]) @ change.T
    other = np.array([symmetry.matrix(q) for q in symmetry.group("I4")])
    assert np.abs(moved.reshape(-1, 1, 9) - other.reshape(1, -1, 9)).max(2).min(1).max() < 1e-6


def test_unknown_groups_fail():
    for symbol in ("Q3", "I_4z", ""):
        with pytest.raises(ValueError):
            symmetry.group(symbol)


def test_distances_up_to_symmetry(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(20, 6))
    df = spark.createDataFrame(points.tolist(), "a double, b double, c double, d double, e double, f double")
    p, q = tuple(map(F.col, "abc")), tuple(map(F.col, "def"))
    group = np.array([symmetry.matrix(s) for s in symmetry.group("O")])
    want = [np.linalg.norm(group @ r[3:] - r[:3], axis=1).min() for r in points]
    assert np.allclose(sorted(want), sorted(r[0] for r in df.select(symmetry.point_distance(p, q, "O")).collect()))
    turned = np.einsum("gij,nj->gni", group, points[:, :3]) - points[:, 3:]
    got = df.agg(*[symmetry.set_distance(p, q, "O", m) for m in ("mse", "rmse", "max")]).first()
    assert np.allclose(got, [(turned**2).sum(2).mean(1).min(), np.sqrt((turned**2).sum(2).mean(1).min()), np.abs(turned).max((1, 2)).min()])
    first = angles.euler_to_quaternion(F.lit(10.0), F.lit(20.0), F.lit(30.0))
    same = angles.euler_to_quaternion(F.lit(100.0), F.lit(20.0), F.lit(30.0))  # a quarter turn about z follows
    row = spark.range(1).select(symmetry.rotation_distance(first, same, "C4"), symmetry.rotation_distance(first, same, "C1"), symmetry.rotation_distance(first, same, "C1", "chordal")).first()
    assert np.allclose(row, [0, 90, 2], atol=1e-4)


def test_conversion(spark):
    rows = [(0, 0, "s.mrcs", 2.0, [0.5, 1.0], 0.25, 0.75, [4096, 2048], 7001, 30.0, [0.0, 0.0, np.pi / 2]), (1, 1, "s.mrcs", 2.0, [0.0, 0.0], 0.5, 0.5, [4096, 2048], 9001, 10.0, None), (2, 2, "s.mrcs", None, None, None, None, None, 7001, 10.0, [0.0, 0.0, 0.0])]
    names = ["rid", "blob/idx", "blob/path", "blob/psize_A", "alignments2D/shift", "location/center_x_frac", "location/center_y_frac", "location/micrograph_shape", "filament/filament_uid", "filament/position_A", "alignments3D/pose"]
    kinds = ["long", "long", "string", "double", "array<double>", "double", "double", "array<long>", "long", "double", "array<double>"]
    df = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds)))
    assert convention(df) == "export"
    got = to_star(df).orderBy("rid").collect()
    assert [r["rlnImageName"] for r in got] == ["000001@s.mrcs", "000002@s.mrcs", "000003@s.mrcs"]
    assert (got[0]["rlnOriginXAngst"], got[0]["rlnOriginYAngst"], got[2]["rlnOriginXAngst"]) == (-1.0, -2.0, None)
    assert (got[0]["rlnCoordinateX"], got[0]["rlnCoordinateY"]) == (512.0, 3072.0)
    assert [r["rlnHelicalTubeID"] for r in got] == [1, 2, 1]
    assert [r["rlnHelicalTrackLengthAngst"] for r in got] == [20.0, 0.0, 0.0]
    assert abs(got[0]["rlnAngleRot"] - 90) < 1e-9 and got[1]["rlnAngleRot"] is None
    assert to_star(to_star(df)).columns == to_star(df).columns
    with pytest.raises(ValueError):
        to_star(df.select("rid"))
    e = spark.range(1).select(*rotation_vector_to_euler(F.array(F.lit(0.0), F.lit(0.5), F.lit(0.0)))).first()
    assert np.allclose(e, [0, np.degrees(0.5), 0])


def test_structured_exports(spark, tmp_path):
    table = np.zeros(3, dtype=[("uid", "u8"), ("blob/path", "S16"), ("blob/idx", "i8"), ("pose", "f4", (3,)), ("ctf/type", "S4")])
    table["uid"], table["blob/path"], table["blob/idx"], table["pose"][:, 1] = [2**63 + 5, 7, 8], b"a.mrcs", [0, 1, 2], 0.5
    more = np.zeros(2, dtype=[("uid", "u8"), ("blob/idx", "i8"), ("score", "f8")])
    more["uid"], more["score"], more["blob/idx"] = [7, 2**63 + 5], [0.7, 0.9], 99
    for name, t in (("a.cs", table), ("p.cs", more)):
        with open(tmp_path / name, "wb") as f:
            np.save(f, t)
    got = read_export(spark, f"file://{tmp_path}/a.cs", f"file://{tmp_path}/p.cs").orderBy("rid").collect()
    assert [r["score"] for r in got] == [0.9, 0.7, None]
    assert [r["blob/idx"] for r in got] == [0, 1, 2] and got[1]["pose"] == [0.0, 0.5, 0.0] and got[0]["blob/path"] == "a.mrcs"
    assert np.int64(got[0]["uid"]).astype(np.uint64) == 2**63 + 5 and "ctf/type" not in got[0].asDict()
    both = read_tables(spark, [f"file://{tmp_path}/a.cs", f"file://{tmp_path}/p.cs"])
    assert both.count() == 5 and both.where("source = 1 and pose is null").count() == 2
    with pytest.raises(ValueError):
        read_tables(spark, ["a.xyz"])


def test_average_rotation_equals_the_dense_solution(spark):
    rng = np.random.default_rng(5)
    rows = [(k % 2, *(rng.normal(scale=8, size=3) + [40, 60, 20]).tolist()) for k in range(40)]
    df = spark.createDataFrame(rows, "g long, rot double, tilt double, psi double")
    got = {r["g"]: (r["rot"], r["tilt"], r["psi"]) for r in average_rotation(df, ["g"]).collect()}
    for g in (0, 1):
        e = np.radians([r[1:] for r in rows if r[0] == g]) / 2
        a, b, c = e.T
        q = np.stack([np.cos(b) * np.cos(a + c), np.sin(b) * np.sin(c - a), np.sin(b) * np.cos(c - a), np.cos(b) * np.sin(a + c)], 1)
        w, x, y, z = np.linalg.eigh(q.T @ q)[1][:, -1]
        m = np.array(symmetry.matrix((w, x, y, z)))
        want = np.degrees([np.arctan2(m[1, 2], m[0, 2]), np.arccos(m[2, 2]), np.arctan2(m[2, 1], -m[2, 0])])
        assert np.allclose(got[g], want)


def test_elbow(spark):
    df = spark.createDataFrame([(1, x, y) for x, y in enumerate([10.0, 4.0, 1.0, 0.5, 0.2, 0.0])], "g long, x long, y double")
    assert [r["x"] for r in elbow(df, ["g"], "x", "y").collect()] == [2]
