"""Ranks, running sums and order statistics of whole tables, by ranges of the order: no task gets more than one range."""

from __future__ import annotations

from datetime import datetime

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges into which an order is cut; their bounds are rows chosen by a hash. A row meets the bounds of STEP ranges at once, then those inside.
RANGES, STEP = 256, 16


def _literal(value: object, kind: str) -> str:
    """A value of a column type in SQL; strings as their bytes."""
    if value is None:
        return f"CAST(NULL AS {kind})"
    if isinstance(value, datetime):
        return f"CAST(timestamp_micros({round(value.timestamp() * 1_000_000)}) AS {kind})"
    return f"CAST(X'{value.encode().hex()}' AS STRING)" if isinstance(value, str) else f"CAST('{value}' AS {kind})"


def running_before(df: DataFrame, order: list[str], value: Column, name: str, ranges: int = RANGES) -> DataFrame:
    """df with the sum of value over all rows before each one in ascending order (nulls first).

    The rows with the least hashes of the order's columns cut it into ranges; sums run
    inside ranges, and the sums of the ranges, at most RANGES + 1 rows, run in one place.
    """
    edges = df.select(*order).orderBy(F.xxhash64(*order), *order).limit(ranges).collect()
    edges.sort(key=lambda e: tuple((v is not None, v) if v is not None else (False, 0) for v in e))
    at = F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(order)])
    kinds = [df.schema[c].dataType.simpleString() for c in order]
    literal = lambda es: F.expr("array(" + ", ".join("named_struct(" + ", ".join(f"'c{k}', {_literal(v, t)}" for k, (v, t) in enumerate(zip(e, kinds))) + ")" for e in es) + ")")
    if edges:
        block = F.size(F.filter(literal(edges[::STEP]), lambda e: e <= at))
        fine = F.filter(F.slice(literal(edges), F.greatest(F.lit(1), (block - 1) * STEP + 1), F.lit(STEP)), lambda e: e <= at)
        part = F.when(block == 0, F.lit(0)).otherwise((block - 1) * STEP + F.size(fine))
    else:
        part = F.lit(0)
    rows = df.withColumn("_part", part).withColumn("_value", value)
    sums = rows.groupBy("_part").agg(F.sum("_value").alias("_sum"))
    sums = sums.select("_part", (F.sum("_sum").over(Window.orderBy("_part")) - F.col("_sum")).alias("_from"))
    inside = F.sum("_value").over(Window.partitionBy("_part").orderBy(*[F.asc_nulls_first(f"`{c}`") for c in order]).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value")
    return rows.withColumn("_inside", inside).join(F.broadcast(sums), "_part").withColumn(name, F.col("_from") + F.col("_inside")).drop("_part", "_value", "_inside", "_from")


def numbered(df: DataFrame, order: list[str], name: str, start: int = 1) -> DataFrame:
    """df with a dense number from start in ascending order of columns whose values together are unique."""
    out = running_before(df, order, F.lit(1).cast("long"), name)
    return out.withColumn(name, (F.col(name) + start).cast("int"))


def kth_smallest(df: DataFrame, column: str, k: int, cuts: int = 1000) -> float | None:
    """The k-th smallest value (from 1): each pass counts the rows between approximate quantiles and goes on inside the range that holds it."""
    rows = df.where(F.col(column).isNotNull()).select(column)
    n = rows.count()
    if not 1 <= k <= n:
        return None
    while True:
        edges = sorted(set(rows.agg(F.percentile_approx(column, [j / cuts for j in range(cuts + 1)], 10 * cuts)).first()[0]))
        low, high = rows.agg(F.min(column), F.max(column)).first()
        if low == high:
            return low
        splits = sorted({low, *edges, high})
        parted = Bucketizer(splits=[float("-inf"), *splits, float("inf")], inputCol="_x", outputCol="_part").transform(rows.withColumn("_x", F.col(column).cast("double")))
        counts = sorted((r["_part"], r["n"]) for r in parted.groupBy("_part").agg(F.count("*").alias("n")).collect())  # at most cuts + 3 rows
        for at, m in counts:
            if k <= m:
                break
            k -= m
        rows = parted.where(F.col("_part") == at).select(column)
