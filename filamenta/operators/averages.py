"""Average rotations and points of greatest bend, by group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import euler_to_quaternion, quaternion_to_euler


def average_rotation(df: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """(keys, rot, tilt, psi): the rotation whose quaternion is the principal axis of the weighted sum of outer products.

    The ten sums are aggregated by Spark; a task only solves one 4 x 4 problem a group.
    """
    q = euler_to_quaternion(F.col("rot"), F.col("tilt"), F.col("psi"))
    weight = F.lit(1.0) if weight is None else weight
    cells = [(i, j) for i in range(4) for j in range(i, 4)]
    sums = df.groupBy(*keys).agg(*[F.sum(weight * q[i] * q[j]).alias(f"_m{i}{j}") for i, j in cells])

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            m = np.zeros((len(part), 4, 4))
            for i, j in cells:
                m[:, i, j] = m[:, j, i] = part[f"_m{i}{j}"].fillna(0.0).to_numpy(float)
            axis = np.linalg.eigh(m)[1][:, :, -1]
            yield part[keys].assign(**{f"_{c}": axis[:, k] for k, c in enumerate("wxyz")})

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys) + ", _w double, _x double, _y double, _z double"
    mean = sums.mapInPandas(solve, schema)
    return mean.select(*keys, *[c.alias(n) for c, n in zip(quaternion_to_euler(*[F.col(f"_{c}") for c in "wxyz"]), ("rot", "tilt", "psi"))])


def elbow(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """(keys, x): the point of each curve farthest from the chord between its ends; of ties, the first."""
    ends = df.groupBy(*keys).agg(F.min_by(F.struct(x, y), x).alias("_a"), F.max_by(F.struct(x, y), x).alias("_b"))
    dx, dy = F.col(f"_b.{x}") - F.col(f"_a.{x}"), F.col(f"_b.{y}") - F.col(f"_a.{y}")
    away = F.round(F.abs(dx * (F.col(y) - F.col(f"_a.{y}")) - dy * (F.col(x) - F.col(f"_a.{x}"))), 6)
    far = df.join(ends, keys).groupBy(*keys).agg(F.max(F.struct(away.alias("away"), (-F.col(x)).alias("back"))).alias("_f"))
    return far.select(*keys, (-F.col("_f.back")).alias(x))
