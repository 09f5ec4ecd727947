"""Helical consistency from table to table: one slope for all filaments, their errors on it, and the two widths of the errors' histogram."""

from __future__ import annotations

from math import ceil

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Written
from .filaments import angular_consistency, fit_slopes
from .grouping import first_seen_ids, sorted_ids
from .ranking import kth_smallest, numbered


def long_filaments(df: DataFrame, keys: list[str], least: int = 25) -> DataFrame:
    """The keys of the filaments of at least so many segments."""
    return df.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")


def angle_period(df: DataFrame, keys: list[str], least: int = 25) -> float | None:
    """360 over the symmetry that the breadth of the angle rot tells, over the segments of long filaments; None without any.

    The symmetry is 360 over the breadth, rounded down from 0.3 above, and 2 at least (all
    angles equal: 2).
    """
    low, high = df.join(long_filaments(df, keys, least), keys, "left_semi").agg(F.min("rot"), F.max("rot")).first()
    if low is None:
        return None
    return 360.0 / max(2, int(360.0 / (high - low) + 0.3) if high > low else 2)


def common_slope(df: DataFrame, keys: list[str], period: float, least: int = 25, slopes: int = 1201, reach: float = 1.1) -> float | None:
    """The size of the slope of the filament whose line fits best; ties to the filament with the smallest keys. None without long filaments."""
    best = fit_slopes(df, keys, least, slopes, reach, period).orderBy(F.round("sse", 6), *keys).select("slope").first()
    return abs(best[0]) if best else None


def segment_consistency(df: DataFrame, keys: list[str], least: int = 25, slopes: int = 1201, reach: float = 1.1) -> tuple[DataFrame, DataFrame, float | None, float | None]:
    """(rows, filaments, slope, period) of segments with rot along track; rid orders rows.

    rows: all of df with filament (from 0, by keys), good (mean distance of its filament's
    angles from the line of the common slope, up or down) and good_segment (its own); 0 for
    filaments of fewer than `least` segments. filaments: (keys, filament, segments, slope,
    error: sum of distances, place: from 1 by error, ties by keys) of the long ones. Without
    long filaments rows have zeros, filaments is empty, slope and period are None. Rows with
    a null rot or track take no part in fits and have a null good_segment.

    The slope and the period are the only values that come to the driver. Filaments meet
    in one row each for the slopes; all else are aggregations on their keys.
    """
    named = sorted_ids(df, keys, "filament", 0)
    whole = named.where(F.col("rot").isNotNull() & F.col("track").isNotNull())
    period = angle_period(whole, keys, least)
    slope = common_slope(whole, keys, period, least, slopes, reach) if period else None
    if slope is None:
        zero = F.lit(0.0)
        none = named.groupBy(*keys, "filament").agg(F.count("*").alias("segments")).where("false")
        return named.withColumn("good", zero).withColumn("good_segment", zero), none.select(*keys, "filament", "segments", zero.alias("slope"), zero.alias("error"), F.lit(0).alias("place")), None, None
    fitted = angular_consistency(whole, keys, slope, period, least)
    errors = Written(df.sparkSession).keep(fitted.groupBy(*keys, "filament").agg(F.count("*").alias("segments"), F.max("filament_slope").alias("slope"), F.sum("segment_error").alias("error")))
    filaments = numbered(errors.withColumn("_e", F.round("error", 6)), ["_e", *keys], "place").drop("_e")
    on_rows = fitted.select("rid", F.col("segment_error").alias("good_segment"))
    means = errors.select("filament", (F.col("error") / F.col("segments")).alias("good"))
    rows = named.join(on_rows, "rid", "left").join(means, "filament", "left")
    given = F.col("rot").isNotNull() & F.col("track").isNotNull()
    rows = rows.withColumn("good_segment", F.when(given, F.coalesce("good_segment", F.lit(0.0)))).withColumn("good", F.coalesce("good", F.lit(0.0)))
    return rows.select(*[F.col(f"`{c}`") for c in named.columns], "good", "good_segment"), filaments, slope, period


def named_segments(df: DataFrame, rid: str, image: str = "rlnImageName") -> DataFrame:
    """df with the number of each row in order (part), the micrograph in its image name and that micrograph's number (from 0, in order of appearance)."""
    out = numbered(df, [rid], "part", 0).withColumn("micrograph", F.element_at(F.split(image, "@"), -1))
    return first_seen_ids(out, ["micrograph"], rid, "micrograph_id", 0)


def quantile(df: DataFrame, column: str, share: float) -> float | None:
    """The exact quantile, linear between neighbours, by ranges of the order; None without values."""
    n = df.where(F.col(column).isNotNull()).count()
    if not n:
        return None
    at = share * (n - 1)
    low = kth_smallest(df, column, int(at) + 1)
    part = at - int(at)
    return low + (kth_smallest(df, column, int(at) + 2) - low) * part if part else low


def error_histogram(df: DataFrame, column: str, high: float) -> DataFrame:
    """(bin, center, n) over [0, high], the last bin closed: as many equal bins as the width 2 IQR / n ** (1/3) needs, one where that is 0; empty bins are there.

    Values outside take no part. Bins grow with the cube root of the rows.
    """
    written = Written(df.sparkSession)
    inside = written.keep(df.where(F.col(column).between(0.0, high)).select(column))
    n = inside.count()
    width = 2.0 * (quantile(inside, column, 0.75) - quantile(inside, column, 0.25)) / n ** (1 / 3) if n else 0.0
    bins = max(1, ceil(high / width)) if width > 0 else 1
    at = F.least(F.floor(F.col(column) / high * bins), F.lit(bins - 1)).cast("long")
    counts = written.keep(inside.groupBy(at.alias("bin")).agg(F.count("*").alias("n")))
    written.close(counts)
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", ((F.col("bin") + 0.5) * (high / bins)).alias("center"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _profile(x: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(model, its derivatives) at x of two centred bells of heights p[0], p[2] and deviations exp(p[1]), exp(p[3])."""
    s, t = x * np.exp(-p[1]), x * np.exp(-p[3])
    a, b = np.exp(-0.5 * s * s), np.exp(-0.5 * t * t)
    return p[0] * a + p[2] * b, np.stack([a, p[0] * a * s * s, b, p[2] * b * t * t], axis=1)


def _heights(x: np.ndarray, y: np.ndarray, weight: np.ndarray, one: float, other: float) -> tuple[float, np.ndarray]:
    """(cost, parameters) of the best heights for two logarithms of deviations."""
    bells = _profile(x, np.array([0.0, one, 0.0, other]))[1][:, [0, 2]]
    root = np.sqrt(weight)
    h = np.linalg.lstsq(bells * root[:, None], y * root, rcond=None)[0]
    return float((weight * (y - bells @ h) ** 2).sum()), np.array([h[0], one, h[1], other])


def error_profile(df: DataFrame, column: str, period: float, rounds: int = 500) -> dict[str, float]:
    """Heights and deviations of a peak and a tail, both centred on 0, whose sum fits the histogram of errors in [0, period / 2] with the least squares over counts (weights 1 / (n + 1/2), empty bins left out).

    Spark counts the histogram; its bins, a cube root of the rows, are fitted by damped
    steps from the best of a grid of deviations of up to two periods. The narrower bell is
    the peak. Fewer than four filled bins: all zeros but the
    height of the fullest.
    """
    bins = [(r["center"], r["n"]) for r in error_histogram(df, column, period / 2).where("n > 0").orderBy("bin").collect()]
    names = ("peak", "peak_deviation", "tail", "tail_deviation")
    if len(bins) < 4:
        return dict(zip(names, (float(max((n for _, n in bins), default=0)), 0.0, 0.0, 0.0)))
    x, y = np.array(bins, float).T
    weight = 1.0 / (y + 0.5)
    grid = np.log(np.geomspace(x[0], 2 * period, 32))
    cost, p = min((_heights(x, y, weight, one, other) for k, one in enumerate(grid) for other in grid[k + 1 :]), key=lambda found: found[0])
    model, slopes = _profile(x, p)
    damping = 1e-3
    for _ in range(rounds):
        square = slopes.T @ (weight[:, None] * slopes)
        tried = p + np.linalg.solve(square + damping * np.diag(np.diag(square) + 1e-12), slopes.T @ (weight * (y - model)))
        tried[[1, 3]] = np.clip(tried[[1, 3]], grid[0] - 3, grid[-1])
        next_model, next_slopes = _profile(x, tried)
        next_cost = float((weight * (y - next_model) ** 2).sum())
        if next_cost <= cost:
            done = cost - next_cost <= 1e-14 * cost
            p, model, slopes, cost, damping = tried, next_model, next_slopes, next_cost, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    one, other = sorted([(np.exp(p[1]), p[0]), (np.exp(p[3]), p[2])])
    return dict(zip(names, map(float, (one[1], one[0], other[1], other[0]))))
