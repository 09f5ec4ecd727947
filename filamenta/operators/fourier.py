"""Discrete Fourier transforms of maps as rows of voxels, axis by axis, and the chain of masked shell correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shells
from .local import soft_mask

AXES = ["z", "y", "x"]


def transformed(df: DataFrame, keys: list[str], sizes: dict[str, int], inverse: bool = False) -> DataFrame:
    """The transform (re, im) of rows (keys, axes, re, im): each axis in turn turns its lines into their sums with roots of unity; places of the axes become frequencies and back.

    A line of voxels is one array. The inverse is divided by the number of voxels.
    """
    for axis, n in sizes.items():
        others = [*keys, *[a for a in sizes if a != axis]]
        lines = df.groupBy(*others).agg(F.sort_array(F.collect_list(F.struct(axis, "re", "im"))).alias("_line"))  # n voxels
        turn = (1 if inverse else -1) * 2 * math.pi / n

        def of(k: Column, axis=axis, turn=turn, n=n) -> Column:
            def step(s: Column, p: Column) -> Column:
                angle = (k * p[axis] % n) * turn
                c, i = F.cos(angle), F.sin(angle)
                return F.struct((s["re"] + p["re"] * c - p["im"] * i).alias("re"), (s["im"] + p["re"] * i + p["im"] * c).alias("im"))

            return F.aggregate("_line", F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), step, lambda s: F.struct(k.alias("k"), (s["re"] / (n if inverse else 1)).alias("re"), (s["im"] / (n if inverse else 1)).alias("im")))

        df = lines.select(*others, F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: of(k))).alias("_t")).select(*others, F.col("_t.k").alias(axis), "_t.re", "_t.im")
    return df


def shell_of(sizes: dict[str, int]) -> Column:
    """The shell of a frequency: the length of its vector, whole, at most half the first size."""
    total = sum(F.pow(F.when(F.col(a) > n // 2, F.col(a) - n).otherwise(F.col(a)) / float(n), 2) for a, n in sizes.items())
    first = next(iter(sizes.values()))
    return F.least(F.bround(F.sqrt(total) * first), F.lit(first // 2)).cast("int")


def phases_randomised(df: DataFrame, keys: list[str], sizes: dict[str, int], first_shell: int, seed: int = 0) -> DataFrame:
    """Coefficients whose phases from a shell on are turned by angles that a hash of map and frequency gives; opposite frequencies turn oppositely, so that the map stays real."""
    other = {a: (F.lit(n) - F.col(a)) % n for a, n in sizes.items()}
    own, opposite = F.struct(*sizes), F.struct(*[x.alias(a) for a, x in other.items()])
    least = F.least(own, opposite)
    key = F.concat_ws(":", *[F.col(k).cast("string") for k in keys], *[least[a].cast("string") for a in sizes], F.lit(str(seed)))
    angle = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / float(1 << 32) * (2 * math.pi)
    angle = F.when(own == opposite, 0.0).when(own == least, angle).otherwise(-angle)
    c, s = F.cos("_angle"), F.sin("_angle")
    turned = df.withColumn("_angle", F.when(shell_of(sizes) >= first_shell, angle).otherwise(0.0))
    return turned.withColumn("_re", F.col("re") * c - F.col("im") * s).withColumn("im", F.col("re") * s + F.col("im") * c).drop("re", "_angle").withColumnRenamed("_re", "re")


def _correlated(df: DataFrame, key: str, sizes: dict[str, int], name: str) -> DataFrame:
    """(key, shell, name): shell correlations of coefficients (key, half, axes, re, im) of halves a and b."""
    pair = [F.max(F.when(F.col("half") == h, F.col(p))).alias(f"{p}_{h}") for h in "ab" for p in ("re", "im")]
    both = df.groupBy(key, *sizes).agg(*pair).withColumn("shell", shell_of(sizes))
    return shells.shell_correlation(both, [key]).select(key, "shell", F.col("fsc").alias(name))


def true_shell_correlation(maps: DataFrame, key: str, sizes: dict[str, int], inside: Column, width: float, first_shell: int) -> DataFrame:
    """(key, shell, unmasked, randomised, masked, corrected) of pairs of maps as rows (key, half: a or b, axes, v).

    The soft mask grows from the voxels where inside, a column of maps, holds. Phases
    from first_shell on are randomised; from the next shell on the masked correlation
    is corrected by that of the masked randomised maps.
    """
    keys = [key, "half"]
    mask = soft_mask(maps.withColumn("_map", F.struct(*keys)), "_map", list(sizes), inside, width).drop("_map")
    real = lambda df, v: df.select(*keys, *sizes, v.alias("re"), F.lit(0.0).alias("im"))
    plain = transformed(real(maps, F.col("v")), keys, sizes)
    mixed = transformed(phases_randomised(plain, keys, sizes, first_shell), keys, sizes, inverse=True).select(*keys, *sizes, F.col("re").alias("_r"))
    masked = transformed(real(mask, F.col("v") * F.col("mask")), keys, sizes)
    noise = transformed(real(mask.join(mixed, [*keys, *sizes]), F.col("_r") * F.col("mask")), keys, sizes)
    out = _correlated(plain, key, sizes, "unmasked").join(_correlated(noise, key, sizes, "randomised"), [key, "shell"]).join(_correlated(masked, key, sizes, "masked"), [key, "shell"])
    return out.withColumn("corrected", F.when(F.col("shell") > first_shell, shells.corrected(F.col("masked"), F.col("randomised"))).otherwise(F.col("masked")))
