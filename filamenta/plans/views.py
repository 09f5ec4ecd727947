"""Particle-like views of the test tables, for queries and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    turn = lambda k: F.pmod(F.col("value") * k, F.lit(360.0))
    return e.select(
        F.col("event_id").alias("rid"), F.col("user_id").alias("mic"), F.col("event_type").alias("tube"),
        (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("track"), turn(36.0).alias("psi"), turn(77.0).alias("rot"), (turn(11.0) / 2).alias("tilt"),
        (F.col("event_id") % 5 + 1).alias("cls"), F.col("value").alias("score"), F.format_string("%06d@stack_%d.mrcs", F.col("event_id"), F.col("user_id")).alias("image"),
        (F.col("value") % 100).alias("x"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 % 100).alias("y"),
        (F.col("value") * 10 + 10000).alias("defocus_u"), (F.col("value") * 9 + 10000).alias("defocus_v"), F.lit(2.7).alias("cs"), F.lit(1.25).alias("apix"),
    )


def _turn(k: str) -> str:
    """As Spark's pmod: 360 is added only to what is negative, or last bits would differ."""
    return f"CASE WHEN (value * {k}) % 360.0 < 0 THEN ((value * {k}) % 360.0 + 360.0) % 360.0 ELSE (value * {k}) % 360.0 END"


SEG = f"""seg AS (SELECT event_id AS rid, user_id AS mic, event_type AS tube, epoch_us(ts) / 1e6 AS track,
  {_turn('36.0')} AS psi, {_turn('77.0')} AS rot, ({_turn('11.0')}) / 2 AS tilt,
  event_id % 5 + 1 AS cls, value AS score, printf('%06d@stack_%d.mrcs', event_id, user_id) AS image,
  value % 100 AS x, (epoch_us(ts) / 1e6) % 100 AS y, value * 10 + 10000 AS defocus_u, value * 9 + 10000 AS defocus_v, CAST(2.7 AS DOUBLE) AS cs, CAST(1.25 AS DOUBLE) AS apix
  FROM events)"""
