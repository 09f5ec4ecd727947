"""Shell correlations of paired Fourier coefficients, as partial and final aggregation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def shell_correlation(df: DataFrame, keys: list[str], shell: str = "shell") -> DataFrame:
    """(keys, shell, fsc, n) of coefficients (re_a, im_a, re_b, im_b); 0 where one side has no power."""
    power = lambda s: F.sum(F.col(f"re_{s}") * F.col(f"re_{s}") + F.col(f"im_{s}") * F.col(f"im_{s}"))
    norm = F.sqrt(power("a") * power("b"))
    cross = F.sum(F.col("re_a") * F.col("re_b") + F.col("im_a") * F.col("im_b"))
    return df.groupBy(*keys, shell).agg(F.when(norm > 0, cross / norm).otherwise(0.0).alias("fsc"), F.count("*").alias("n"))


def corrected(total: Column, noise: Column) -> Column:
    """The correlation without what a mask brings in, by that of phase-randomised maps."""
    return F.when(noise < 1, (total - noise) / (1 - noise)).otherwise(total)


def crossing(curve: DataFrame, keys: list[str], threshold: float = 0.143, shell: str = "shell") -> DataFrame:
    """(keys, crossing): the first place between two shells where the curve falls below the threshold, by linear interpolation; null if it never does.

    The window runs over the shells of one curve, not over coefficients.
    """
    w = Window.partitionBy(*keys).orderBy(shell)
    both = curve.withColumn("_f", F.lag("fsc").over(w)).withColumn("_s", F.lag(shell).over(w))
    at = F.col("_s") + (F.col("_f") - threshold) / (F.col("_f") - F.col("fsc")) * (F.col(shell) - F.col("_s"))
    falls = (F.col("_f") >= threshold) & (F.col("fsc") < threshold)
    return both.groupBy(*keys).agg(F.min(F.when(falls, at)).alias("crossing"))
