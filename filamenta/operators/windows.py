"""Particle windows cut from micrographs that are stored as tiles, so that no task needs a whole micrograph."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pixels of a tile's side.
TILE = 64


def tiles(pixels: DataFrame, key: str, tile: int = TILE) -> DataFrame:
    """(key, ty, tx, at, values) of pixels (key, y, x, v): the places (row * tile + column) and values of each tile's pixels."""
    placed = pixels.where(F.col("v").isNotNull()).select(key, F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx"), F.struct((F.col("y") % tile * tile + F.col("x") % tile).cast("int").alias("at"), F.col("v").cast("double").alias("v")).alias("_p"))
    lists = placed.groupBy(key, "ty", "tx").agg(F.collect_list("_p").alias("_p"))  # at most a tile
    return lists.select(key, "ty", "tx", F.col("_p.at").alias("at"), F.col("_p.v").alias("values"))


def windows(particles: DataFrame, tiled: DataFrame, key: str, y: Column, x: Column, box: int, rid: str = "rid", tile: int = TILE, fill: str = "mean", sign: int = 1, normalise: bool = False) -> DataFrame:
    """(rid, inside, values) of every particle: the box of pixels around its place, row by row, and how many lie inside the micrograph.

    y, x: places in pixels, rounded half to even. A window asks the tiles that it touches
    and is put together from them. Pixels outside, or without a value, get the mean of
    those inside (fill "mean") or 0 ("zero"); sign -1 turns contrast round between the
    least and the largest value; normalise brings a window that isn't flat to mean 0 and
    deviation 1. A particle without any pixel, or without a place, has null values.
    """
    if fill not in ("mean", "zero"):
        raise ValueError(f"no fill {fill}")
    p = particles.select(F.col(rid).alias("rid"), F.col(key).alias("_key"), (F.bround(y).cast("long") - box // 2).alias("_y0"), (F.bround(x).cast("long") - box // 2).alias("_x0"))
    span = lambda c: F.sequence(F.floor(F.col(c) / tile).cast("int"), F.floor((F.col(c) + box - 1) / tile).cast("int"))
    asked = p.where(F.col("_y0").isNotNull() & F.col("_x0").isNotNull()).withColumn("ty", F.explode(span("_y0"))).withColumn("tx", F.explode(span("_x0")))
    met = asked.join(tiled.withColumnRenamed(key, "_key"), ["_key", "ty", "tx"])
    parts = met.groupBy("rid", "_y0", "_x0").agg(F.collect_list(F.struct("ty", "tx", "at", "values")).alias("parts"))  # the tiles that one window touches

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, out = [], []
            for y0, x0, pieces in zip(batch.column("_y0").to_pylist(), batch.column("_x0").to_pylist(), batch.column("parts")):
                window = np.full((box, box), np.nan)
                for piece in pieces:
                    at = piece["at"].values.to_numpy()
                    row, column = at // tile + piece["ty"].as_py() * tile - y0, at % tile + piece["tx"].as_py() * tile - x0
                    here = (row >= 0) & (row < box) & (column >= 0) & (column < box)
                    window[row[here], column[here]] = piece["values"].values.to_numpy()[here]
                known = ~np.isnan(window)
                counts.append(int(known.sum()))
                if not known.any():
                    out.append(None)
                    continue
                window[~known] = window[known].mean() if fill == "mean" else 0.0
                if sign < 0:
                    window = window.max() + window.min() - window
                if normalise and window.std():
                    window = (window - window.mean()) / window.std()
                out.append(window.ravel())
            yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.array(counts, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["rid", "inside", "values"])

    kind = p.schema["rid"].dataType.simpleString()
    made = parts.mapInArrow(cut, f"rid {kind}, inside long, values array<double>")
    return p.select("rid").join(made, "rid", "left").select("rid", F.coalesce("inside", F.lit(0)).alias("inside"), "values")
