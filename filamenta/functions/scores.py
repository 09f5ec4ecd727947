"""Likeness of two numeric array columns of equal length, inside whole-stage code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _doubles(name: str) -> Column:
    return F.transform(F.col(name), lambda v: v.cast("double"))


def correlation(a: str, b: str) -> Column:
    """Pearson's; 0 where one array is constant."""

    def centred(name: str) -> Column:
        mean = _total(_doubles(name)) / F.size(name)
        return F.transform(_doubles(name), lambda v: v - mean)

    x, y = centred(a), centred(b)
    dot = lambda p, q: _total(F.zip_with(p, q, lambda v, w: v * w))
    norm = F.sqrt(dot(x, x) * dot(y, y))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(x, y) / norm)


def r_factor(a: str, b: str) -> Column:
    """1 / (1 + R) with R = sum |a - b| / sum |b|; 0 where b is all zero."""
    size = _total(F.transform(_doubles(b), F.abs))
    apart = _total(F.zip_with(_doubles(a), _doubles(b), lambda v, w: F.abs(v - w)))
    return F.when(size == 0, F.lit(0.0)).otherwise(1 / (1 + apart / size))


def mutual_information(df: DataFrame, key: str, a: str, b: str, bins: int = 64) -> DataFrame:
    """(key, score) of two array columns: the sum of the entropies of their histograms over that of their joint one, less 1: 1 for images that tell each other, 0 for independent ones and flat ones."""
    values = df.select(key, F.posexplode(F.arrays_zip(a, b)).alias("_i", "_p")).select(key, *[F.col(f"_p.{c}").cast("double").alias(c) for c in (a, b)])
    ends = values.groupBy(key).agg(*[f(c).alias(f"_{n}_{c}") for c in (a, b) for f, n in ((F.min, "low"), (F.max, "high"))])
    at = lambda c: F.least(F.floor((F.col(c) - F.col(f"_low_{c}")) / (F.col(f"_high_{c}") - F.col(f"_low_{c}")) * bins), F.lit(bins - 1))
    both = values.join(ends, key).groupBy(key, F.coalesce(at(a), F.lit(0)).alias("_a"), F.coalesce(at(b), F.lit(0)).alias("_b")).agg(F.count("*").alias("_n"))

    def entropy(counts: DataFrame, name: str) -> DataFrame:
        n = F.sum("_n")
        return counts.groupBy(key).agg((F.ln(n) - F.sum(F.col("_n") * F.ln("_n")) / n).alias(name))

    one, other = (both.groupBy(key, c).agg(F.sum("_n").alias("_n")) for c in ("_a", "_b"))
    joined = entropy(both, "_hab").join(entropy(one, "_ha"), key).join(entropy(other, "_hb"), key)
    return joined.select(key, F.when(F.col("_hab") > 0, (F.col("_ha") + F.col("_hb")) / F.col("_hab") - 1).otherwise(0.0).alias("score"))
