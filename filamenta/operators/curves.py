"""Falling curves fitted by least squares, each curve in one row: rounds of damped normal equations.

Those of the two models here are made by numpy for the curves of a batch at once; any
other model, given as expressions, by Spark's.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rounds of a fit, each of which tries one step; the first damping; the share by which residuals may rise, so that steps go on below their rounding.
ROUNDS, DAMPING, SLACK = 60, 1e-3, 1e-13
#: Curves whose rounds numpy makes together.
TOGETHER = 512


def butterworth(s: Column, p: Column, q: Column) -> tuple[Column, Column, Column]:
    """1 / (1 + (s / p)^q) and its derivatives by p and q."""
    u = F.when(s > 0, F.pow(s / p, q)).otherwise(0.0)
    below = (1 + u) * (1 + u)
    return 1 / (1 + u), q / p * u / below, F.when(s > 0, -u * F.ln(F.when(s > 0, s / p).otherwise(1.0)) / below).otherwise(0.0)


def fermi(s: Column, p: Column, q: Column) -> tuple[Column, Column, Column]:
    """(exp(-p / q) + 1) / (exp((s - p) / q) + 1), which is 1 at 0, and its derivatives by p and q."""
    up, down = F.exp((s - p) / q), F.exp(-p / q)
    value, below = (down + 1) / (up + 1), (up + 1) * (up + 1)
    dp = (-down / q * (up + 1) + (down + 1) * up / q) / below
    dq = (down * p / (q * q) * (up + 1) + (down + 1) * up * (s - p) / (q * q)) / below
    return value, dp, dq


def _butterworth(s: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As butterworth, of points (rows) of curves (columns)."""
    u = np.where(s > 0, (np.maximum(s, 0) / p) ** q, 0.0)
    below = (1 + u) * (1 + u)
    return 1 / (1 + u), q / p * u / below, np.where(s > 0, -u * np.log(np.where(s > 0, s / p, 1.0)) / below, 0.0)


def _fermi(s: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As fermi, of points (rows) of curves (columns)."""
    up, down = np.exp((s - p) / q), np.exp(-p / q)
    below = (up + 1) * (up + 1)
    dp = (-down / q * (up + 1) + (down + 1) * up / q) / below
    dq = (down * p / (q * q) * (up + 1) + (down + 1) * up * (s - p) / (q * q)) / below
    return (down + 1) / (up + 1), dp, dq


_IN_BATCHES = {butterworth: _butterworth, fermi: _fermi}


def _rounds(s: np.ndarray, f: np.ndarray, real: np.ndarray, p: np.ndarray, q: np.ndarray, model: Callable, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(p, q, summed squared residuals) of curves in columns, of which only the real points count; NaN counts as larger than any number, as in SQL."""

    def sums(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        value, dp, dq = model(s, p, q)
        r = f - value
        return np.stack([np.where(real, v, 0.0).sum(0) for v in (r * r, dp * dp, dp * dq, dq * dq, dp * r, dq * r)])

    t, d = sums(p, q), np.full(len(p), DAMPING)
    for _ in range(rounds):
        a, b, c = t[1] * (1 + d), t[2], t[3] * (1 + d)
        det = a * c - b * b
        p1, q1 = p + (c * t[4] - b * t[5]) / det, q + (a * t[5] - b * t[4]) / det
        tried = sums(p1, q1)
        better = (det != 0) & ~(p1 <= 0) & ~(q1 <= 0) & ((tried[0] <= t[0] * (1 + SLACK)) | np.isnan(t[0]))
        p, q, t, d = np.where(better, p1, p), np.where(better, q1, q), np.where(better, tried, t), np.where(better, d / 10, d * 10)
    return p, q, t[0]


def _in_batches(model: Callable, rounds: int):
    """A function of the batches of (s, f, first p, first q) of curves with three points at least."""

    @F.arrow_udf("p double, q double, e double")
    def fit(s: pa.Array, f: pa.Array, p: pa.Array, q: pa.Array) -> pa.Array:
        size = pc.list_value_length(s).to_numpy(zero_copy_only=False)
        ends, x, y = np.cumsum(size), s.flatten().to_numpy(zero_copy_only=False), f.flatten().to_numpy(zero_copy_only=False)
        starts = [v.to_numpy(zero_copy_only=False) for v in (p, q)]
        out = np.full((len(s), 3), np.nan)
        order = np.argsort(size, kind="stable")  # curves of like lengths together
        for rows in (order[a : a + TOGETHER] for a in range(0, len(order), TOGETHER)):
            most = size[rows[-1]]
            if not most:
                continue
            place = np.arange(most)[:, None]
            real = place < size[rows]
            at = np.where(real, (ends - size)[rows] + place, 0)
            with np.errstate(all="ignore"):
                u, v, e = _rounds(np.where(real, x[at], 1.0), np.where(real, y[at], 0.0), real, *(w[rows] for w in starts), model, rounds)
                out[rows] = np.stack([u, v, e / size[rows]], 1)
        return pa.StructArray.from_arrays([pa.array(c) for c in out.T.copy()], ["p", "q", "e"])  # NaN stays NaN

    return fit


def _sums(points: Column, model: Callable, p: Column, q: Column) -> Column:
    """Of a curve's points the squared residuals e and the sums of the normal equations."""
    names = ("e", "pp", "pq", "qq", "pr", "qr")

    def add(t: Column, x: Column) -> Column:
        value, dp, dq = model(x["s"], p, q)
        r = x["f"] - value
        return F.struct(*[(t[n] + v).alias(n) for n, v in zip(names, (r * r, dp * dp, dp * dq, dq * dq, dp * r, dq * r))])

    return F.aggregate(points, F.struct(*[F.lit(0.0).alias(n) for n in names]), add)


def fitted(df: DataFrame, key: str, s: str, f: str, model: Callable, start: Callable[[Column], tuple[Column, Column]], name: str, rounds: int = ROUNDS) -> DataFrame:
    """(key, points, name: struct of p, q and e, the mean squared residual) of curves as rows (key, s, f).

    start: of the array of points (s, f) the first p and q. A step is taken if it
    doesn't raise the residuals and leaves p and q positive; the damping falls tenfold after
    it, else rises tenfold. Points that are null or not finite don't count; a curve
    with fewer than three has nulls.
    """
    point = F.struct(F.col(s).cast("double").alias("s"), F.col(f).cast("double").alias("f"))
    fine = (F.abs(F.col(s)) < float("inf")) & (F.abs(F.col(f)) < float("inf"))
    points = df.groupBy(key).agg(F.sort_array(F.collect_list(F.when(fine, point))).alias("points"))  # the points of one curve
    return points.select(key, "points", _fit(F.col("points"), model, start, rounds).alias(name))


def _fit(points: Column, model: Callable, start: Callable[[Column], tuple[Column, Column]], rounds: int) -> Column:
    def state(p: Column, q: Column, damping: Column, sums: Column) -> Column:
        return F.struct(p.alias("p"), q.alias("q"), damping.alias("d"), sums.alias("t"))

    def step(now: Column, _: Column) -> Column:
        t, d = now["t"], now["d"]
        a, b, c = t["pp"] * (1 + d), t["pq"], t["qq"] * (1 + d)
        det = a * c - b * b
        p, q = now["p"] + (c * t["pr"] - b * t["qr"]) / det, now["q"] + (a * t["qr"] - b * t["pr"]) / det
        # tried is an array of one, so that its sums are worked out once
        tried = F.transform(F.array(F.struct(p.alias("p"), q.alias("q"))), lambda x: state(x["p"], x["q"], d / 10, _sums(points, model, x["p"], x["q"])))
        allowed = (det != 0) & (p > 0) & (q > 0)
        better = F.filter(F.when(allowed, tried).otherwise(F.array().cast("array<struct<p:double,q:double,d:double,t:struct<e:double,pp:double,pq:double,qq:double,pr:double,qr:double>>>")), lambda x: x["t"]["e"] <= t["e"] * (1 + SLACK))
        return F.coalesce(F.get(better, F.lit(0)), state(now["p"], now["q"], d * 10, t))

    p, q = (x.cast("double") for x in start(points))
    if model in _IN_BATCHES:
        done = _in_batches(_IN_BATCHES[model], rounds)(F.transform(points, lambda x: x["s"]), F.transform(points, lambda x: x["f"]), p, q)
        return F.when(F.size(points) >= 3, done)
    first = state(p, q, F.lit(DAMPING), _sums(points, model, p, q))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), first, step, lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q"), (x["t"]["e"] / F.size(points)).alias("e")))
    return F.when(F.size(points) >= 3, done)


def middle(points: Column) -> Column:
    """The place of the middle point."""
    return F.get(points, F.floor(F.size(points) / 2).cast("int"))["s"]


def falling_fits(df: DataFrame, key: str, s: str, f: str, rounds: int = ROUNDS) -> DataFrame:
    """(key, model, p, q, error) of curves that fall from 1: the better of a Butterworth and a Fermi curve by least squares (ties: butterworth).

    As the correlation curves that these stand for, points outside -0.1 .. 1.1 don't count.
    """
    usable = df.where(F.col(f).between(-0.1, 1.1))
    one = fitted(usable, key, s, f, butterworth, lambda x: (middle(x), F.lit(2.0)), "b", rounds)
    both = one.withColumn("g", _fit(F.col("points"), fermi, lambda x: (middle(x), middle(x) / 5), rounds))
    second = F.coalesce(F.col("g.e") < F.col("b.e"), F.lit(False))
    best = lambda c: F.when(second, F.col(f"g.{c}")).otherwise(F.col(f"b.{c}"))
    return both.select(key, F.when(F.col("b").isNotNull(), F.when(second, "fermi").otherwise("butterworth")).alias("model"), best("p").alias("p"), best("q").alias("q"), best("e").alias("error"))


def area(model: Column, p: Column, q: Column, low: Column, high: Column, steps: int = 499) -> Column:
    """The mean height of a fitted curve between two places, by trapezia of equal width; 0 without a range."""
    at = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda k: low + (high - low) * k / steps)
    value = F.transform(at, lambda s: F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.when(model == "fermi", fermi(s, p, q)[0]).otherwise(butterworth(s, p, q)[0]))))
    ends = (F.get(value, F.lit(0)) + F.get(value, F.lit(steps))) / 2
    total = F.aggregate(value, F.lit(0.0), lambda t, v: t + v) - ends
    return F.when(high > low, total / steps).otherwise(0.0)
