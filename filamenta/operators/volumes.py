"""Operators on volumes as rows of voxels (map, z, y, x, v), so that no task gets a whole map."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def voxels(df: DataFrame, key: str, values: str, ny: int, nx: int) -> DataFrame:
    """(map, z, y, x, v) of an array column in order of section, row, column."""
    flat = df.select(F.col(key).alias("map"), F.posexplode(values).alias("_i", "v"))
    i = F.col("_i")
    return flat.select("map", F.floor(i / (ny * nx)).cast("int").alias("z"), (F.floor(i / nx) % ny).cast("int").alias("y"), (i % nx).cast("int").alias("x"), F.col("v").cast("double").alias("v"))


def flipped(df: DataFrame, axis: str, size: int) -> DataFrame:
    """The other hand: places along one axis in reverse order."""
    return df.withColumn(axis, F.lit(size - 1) - F.col(axis))


def clipped(df: DataFrame, start: dict[str, int], size: dict[str, int]) -> DataFrame:
    """The box from start on, with its own coordinates from 0; places outside the map have 0."""
    inside = [(F.col(c) >= start[c]) & (F.col(c) < start[c] + size[c]) for c in "zyx"]
    there = df.where(inside[0] & inside[1] & inside[2]).select("map", *[(F.col(c) - start[c]).cast("int").alias(c) for c in "zyx"], "v")
    grid = df.select("map").distinct()
    for c in "zyx":
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(size[c] - 1))))
    return grid.join(there, ["map", "z", "y", "x"], "left").withColumn("v", F.coalesce("v", F.lit(0.0)))


def z_moving_average(df: DataFrame, length: int, size: int) -> DataFrame:
    """The mean of length sections around each one, from length // 2 - 1 before on; sections too near either end, of size in all, stay."""
    half = length // 2
    w = Window.partitionBy("map", "y", "x").orderBy("z").rowsBetween(1 - half, length - half)
    whole = (F.col("z") >= half) & (F.col("z") < size - (length - half))
    return df.withColumn("v", F.when(whole, F.avg("v").over(w)).otherwise(F.col("v")))


def _by_map(df: DataFrame, **measures) -> DataFrame:
    """Measures of a map are aggregated in part first, then joined to its voxels."""
    return df.join(df.groupBy("map").agg(*[m.alias(n) for n, m in measures.items()]), "map")


def stretched(df: DataFrame, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Values moved and scaled so that they reach from low to high; a flat map becomes low."""
    d = _by_map(df, _a=F.min("v"), _b=F.max("v"))
    return d.withColumn("v", F.when(F.col("_b") > F.col("_a"), (F.col("v") - F.col("_a")) / (F.col("_b") - F.col("_a")) * (high - low) + low).otherwise(low)).drop("_a", "_b")


def standardised(df: DataFrame, mean: float = 0.0, deviation: float = 1.0) -> DataFrame:
    """Values moved and scaled to a mean and population deviation; a flat map becomes mean."""
    d = _by_map(df, _m=F.avg("v"), _s=F.stddev_pop("v"))
    return d.withColumn("v", F.when(F.col("_s") > 0, (F.col("v") - F.col("_m")) / F.col("_s") * deviation + mean).otherwise(mean)).drop("_m", "_s")


def thresholded(df: DataFrame, value: float) -> DataFrame:
    """Values below the threshold become it, then it is taken off."""
    return df.withColumn("v", F.greatest("v", F.lit(float(value))) - value)


def within_cylinder(df: DataFrame, radius: float, ny: int, nx: int) -> DataFrame:
    """Voxels farther than radius from the axis along z become 0."""
    away = F.sqrt(F.pow(F.col("y") - ny // 2, 2) + F.pow(F.col("x") - nx // 2, 2))
    return df.withColumn("v", F.when(away <= radius, F.col("v")).otherwise(0.0))


def helix_geometry(df: DataFrame) -> DataFrame:
    """(map, angle, center_y, center_x): direction and centre of the mass in the sum over sections, by its moments; 0 without mass."""
    mass = F.sum("v")
    c = df.where("v > 0").groupBy("map").agg(mass.alias("m"), *[(F.sum(F.col("v") * F.col(a)) / mass).alias(f"c{a}") for a in "yx"], *[(F.sum(F.col("v") * F.col(a) * F.col(b)) / mass).alias(f"s{a}{b}") for a, b in ("yy", "xx", "yx")])
    v = lambda a, b: F.col(f"s{a}{b}") - F.col(f"c{a}") * F.col(f"c{b}")
    return c.select("map", F.degrees(F.atan2(2 * v("y", "x"), v("x", "x") - v("y", "y")) / 2).alias("angle"), F.col("cy").alias("center_y"), F.col("cx").alias("center_x"))


def helical_symmetrised(df: DataFrame, size: tuple[int, int, int], apix: float, twist: float, rise: float, csym: int = 1, fraction: float = 1.0) -> DataFrame:
    """Maps of a size (z, y, x) as the mean over the symmetry copies of each place: turned by twist degrees and moved by rise angstrom for each step along z, and turned by the parts of a circle of csym.

    Places between voxels are interpolated linearly. Only sections between the first and
    the last with a hundredth of the fullest one's mass count, of these the fraction of
    the map around their middle; copies outside the map don't count, and a place
    without any is 0. Voxels meet copies by an equality of places, map by map.
    """
    nz, ny, nx = size
    steps = max(1, int(nz * apix / rise))
    sums = df.groupBy("map", "z").agg(F.sum("v").alias("s"))
    most = sums.groupBy("map").agg(F.max("s").alias("most"))
    ends = sums.join(most, "map").where(F.col("s") > 0.01 * F.col("most")).groupBy("map").agg(F.min("z").alias("_z0"), F.max("z").alias("_z1"))
    middle = F.floor((F.col("_z0") + F.col("_z1") + 1) / 2)
    half = int(nz * fraction + 0.5) // 2
    ends = ends.select("map", F.greatest("_z0", middle - half).alias("_z0"), F.least("_z1", middle + half).alias("_z1"))
    turns = [(h, math.radians(twist * h + 360.0 * c / csym)) for h in range(-steps, steps + 1) for c in range(csym)]
    copies = F.explode(F.array(*[F.struct(F.lit(h * rise / apix).alias("up"), F.lit(math.cos(a)).alias("cos"), F.lit(math.sin(a)).alias("sin")) for h, a in turns]))
    grid = ends.select("map", "_z0", "_z1", *[F.lit(0).alias(c) for c in "zyx"])
    for c, n in zip("zyx", size):
        grid = grid.withColumn(c, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    y, x = F.col("y") - ny // 2, F.col("x") - nx / 2
    t = grid.withColumn("_c", copies)
    t = t.withColumn("_k", F.col("z") + F.col("_c.up")).where((F.col("_k") >= F.col("_z0")) & (F.col("_k") < F.col("_z1")))
    t = t.withColumn("_j", F.col("_c.cos") * y + F.col("_c.sin") * x + ny // 2).withColumn("_i", F.col("_c.cos") * x - F.col("_c.sin") * y + nx // 2)
    t = t.where((F.floor("_j") >= 0) & (F.floor("_j") < ny - 1) & (F.floor("_i") >= 0) & (F.floor("_i") < nx - 1))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.lit(c).alias("c")) for a in (0, 1) for b in (0, 1) for c in (0, 1)]))
    t = t.withColumn("_o", corner)
    part = lambda at, step: F.when(step == 1, at - F.floor(at)).otherwise(1 - (at - F.floor(at)))
    weight = part(F.col("_k"), F.col("_o.a")) * part(F.col("_j"), F.col("_o.b")) * part(F.col("_i"), F.col("_o.c"))
    near = t.select("map", "z", "y", "x", weight.alias("_w"), *[(F.floor(f"_{n}") + F.col(f"_o.{o}")).cast("int").alias(f"_{c}") for n, o, c in (("k", "a", "z"), ("j", "b", "y"), ("i", "c", "x"))])
    source = df.select("map", *[F.col(c).alias(f"_{c}") for c in "zyx"], F.col("v").alias("_v"))
    means = near.join(source, ["map", "_z", "_y", "_x"], "left").groupBy("map", "z", "y", "x").agg((F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))) / (F.count("*") / 8)).alias("_m"))
    return grid.drop("_z0", "_z1").join(means, ["map", "z", "y", "x"], "left").withColumn("v", F.coalesce("_m", F.lit(0.0))).drop("_m")
