"""Local measures of images and maps as rows of voxels: sums over boxes by running sums along each axis, structural similarity, distances to a mask."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def box_sums(df: DataFrame, keys: list[str], axes: list[str], size: int, columns: list[str]) -> DataFrame:
    """df with columns summed over the box of `size` voxels a side that ends at each voxel; only voxels whose box is whole stay.

    A summed-area table: along each axis in turn a running sum less the one `size`
    places before. Lines must be without gaps. A window is one line of voxels.
    """
    for axis in axes:
        w = Window.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis)
        run = {c: F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, 0)) for c in columns}
        df = df.withColumns({f"_{c}": x for c, x in run.items()}).withColumn("_at", F.row_number().over(w))
        df = df.withColumns({c: F.col(f"_{c}") - F.coalesce(F.lag(f"_{c}", size).over(w), F.lit(0.0)) for c in columns})
        df = df.where(F.col("_at") >= size).drop("_at", *[f"_{c}" for c in columns])
    return df


def structural_similarity(df: DataFrame, key: str, axes: list[str], a: str = "a", b: str = "b", window: int = 7, k1: float = 0.01, k2: float = 0.03) -> DataFrame:
    """(key, ssim) of images or maps as rows (key, axes, a, b): the mean over all whole windows of the structural similarity, with sample covariances.

    The data range is the larger of both; where both are flat, and where no window fits, the similarity is 0.
    """
    n = float(window ** len(axes))
    ends = df.groupBy(key).agg(F.greatest(F.max(a) - F.min(a), F.max(b) - F.min(b)).cast("double").alias("_range"))
    x, y = F.col(a).cast("double"), F.col(b).cast("double")
    sums = box_sums(df.select(key, *axes, x.alias("sa"), y.alias("sb"), (x * x).alias("saa"), (y * y).alias("sbb"), (x * y).alias("sab")), [key], axes, window, ["sa", "sb", "saa", "sbb", "sab"])
    ux, uy = F.col("sa") / n, F.col("sb") / n
    cov = lambda s, p, q: (F.col(s) / n - p * q) * (n / (n - 1))
    c1, c2 = F.pow(k1 * F.col("_range"), 2), F.pow(k2 * F.col("_range"), 2)
    value = (2 * ux * uy + c1) * (2 * cov("sab", ux, uy) + c2) / ((ux * ux + uy * uy + c1) * (cov("saa", ux, ux) + cov("sbb", uy, uy) + c2))
    means = sums.join(ends, key).where("_range > 0").groupBy(key).agg(F.avg(value).alias("ssim"))
    return ends.select(key).join(means, key, "left").select(key, F.coalesce("ssim", F.lit(0.0)).alias("ssim"))


def otsu_threshold(df: DataFrame, key: str, value: str = "v", bins: int = 256) -> DataFrame:
    """(key, threshold) of maps: the upper edge of the histogram bin that parts values other than 0 with the largest variance between both sides; the least value where there are none."""
    ends = df.groupBy(key).agg(F.min(value).alias("_low"), ((F.max(value) - F.min(value)) / bins).alias("_width"))
    at = F.least(F.floor((F.col(value) - F.col("_low")) / F.col("_width")), F.lit(bins - 1)).cast("int")
    counts = df.where(F.col(value) != 0).join(ends, key).where("_width > 0").groupBy(key, at.alias("_bin")).agg(F.count("*").cast("double").alias("_n"))
    w = Window.partitionBy(key).orderBy("_bin")  # at most `bins` rows
    all_ = Window.partitionBy(key)
    left, total = F.sum("_n").over(w), F.sum("_n").over(all_)
    mass, whole = F.sum(F.col("_n") * F.col("_bin")).over(w), F.sum(F.col("_n") * F.col("_bin")).over(all_)
    sides = counts.select(key, "_bin", left.alias("_l"), (total - left).alias("_r"), mass.alias("_m"), (whole - mass).alias("_h"))
    between = F.when(F.col("_r") > 0, F.col("_l") * F.col("_r") * F.pow(F.col("_m") / F.col("_l") - F.col("_h") / F.col("_r"), 2)).otherwise(0.0)
    best = sides.where("_bin > 0").groupBy(key).agg(F.max(F.struct(between.alias("b"), (-F.col("_bin")).alias("k"))).alias("_best"))
    return ends.join(best, key, "left").select(key, F.coalesce(F.col("_low") + (1 - F.col("_best.k")) * F.col("_width"), F.col("_low")).alias("threshold"))


def squared_distance(df: DataFrame, keys: list[str], axes: list[str], inside: Column, reach: int, name: str = "d2") -> DataFrame:
    """df with the squared distance (in voxels, exact) of each voxel to the nearest one inside, as far as reach along every axis; null beyond.

    Distances are separable: along each axis in turn the running minimum, over the 2 reach + 1 places around, of what the axes before have found plus the square of the step.
    """
    df = df.withColumn(name, F.when(inside, F.lit(0.0)))
    for axis in axes:
        w = Window.partitionBy(*keys, *[a for a in axes if a != axis]).orderBy(axis)
        near = [F.lag(name, k).over(w) + float(k * k) if k > 0 else F.lead(name, -k).over(w) + float(k * k) for k in range(-reach, reach + 1) if k]
        df = df.withColumn("_near", F.least(F.col(name), *near)).drop(name).withColumnRenamed("_near", name)
    return df


def soft_mask(df: DataFrame, key: str, axes: list[str], inside: Column, width: float, name: str = "mask") -> DataFrame:
    """df with a mask of 1 inside and (cos(pi / 2 d / width) + 1) / 2 at a distance d of up to width voxels outside, 0 beyond."""
    if width <= 0:
        return df.withColumn(name, F.when(inside, 1.0).otherwise(0.0))
    out = squared_distance(df, [key], axes, inside, math.ceil(width), "_d2")
    d = F.sqrt("_d2")
    edge = F.when(d == 0, 1.0).when(d <= width, (F.cos(d / width * (math.pi / 2)) + 1) / 2).otherwise(0.0)
    return out.withColumn(name, F.coalesce(edge, F.lit(0.0))).drop("_d2")
