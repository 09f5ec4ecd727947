"""Matching of poses between refinements: against plain loops, and its plans."""

import random

from pyspark.sql import functions as F

from filamenta.operators import mismatch as M


def _poses(spark, n=300, seed=3):
    rng = random.Random(seed)
    rows = [(k, k % 4, rng.uniform(-3, 3), float(rng.randint(0, 3)), [rng.uniform(-2, 2) for _ in range(3)]) for k in range(n)]
    rows[0], rows[1] = (0, 0, -1.0, 2.0, [0.0, 0.0, 0.0]), (1, 1, 0.5, 1.0, [0.0, 0.0, 3.0])
    return rows, spark.createDataFrame(rows, "uid long, mic long, x double, y double, pose array<double>")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_partners_in_place_equal_plain_loops(spark):
    rows, one = _poses(spark)
    moved, other = _poses(spark, seed=4)
    other = other.withColumn("uid", -F.col("uid") - 1)
    got = {r["uid2"]: r["uid1"] for r in M.correspondence(one, other, "pose", distance=0.5).collect()}
    want = {}
    for k, m, x, y, _ in moved:
        near = [(((x - a) ** 2 + (y - b) ** 2) ** 0.5, i) for i, n, a, b, _ in rows if n == m]
        near = [p for p in near if p[0] <= 0.5]
        if near:
            want[-k - 1] = min(near)[1]
    assert got == want and len(want) > 100


def test_no_side_of_a_match_goes_to_the_driver(spark, tmp_path):
    _poses(spark)[1].write.parquet(f"{tmp_path}/one")  # files have a size that Spark knows
    one = spark.read.parquet(f"{tmp_path}/one")
    other = one.withColumn("uid", -F.col("uid") - 1)
    for df in (M.correspondence(one, other, "pose", 0.5, 20.0), M.correspondence(one, one, "pose", axis=20.0)):
        assert "BroadcastExchange" not in _plan(df)


def test_turned_poses_equal_products_of_rotations(spark):
    _, one = _poses(spark)
    angle = F.col("uid") * 7.5
    want = one.select("uid", M.pose_of(M.times(M.about_z(angle), M.rotation_of(F.col("pose")))).alias("want"))
    for r in M.turned(one, "pose", angle).join(want, "uid").collect():
        assert max(abs(a - b) for a, b in zip(r["pose"], r["want"])) < 1e-9, r


def test_poses_are_turned_in_generated_code(spark):
    _, one = _poses(spark)
    other = M.turned(one, "pose", F.lit(17.5) + 120 * (F.col("uid") % 3))
    for df in M.reassigned(one, other, "pose", 2, 3)[:2]:
        assert df.count() == 300 and "lambda" not in _plan(df)
