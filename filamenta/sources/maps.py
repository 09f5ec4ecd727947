"""MRC maps and stacks, and the beam shifts in microscope XML files; Spark reads files as rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .streams import write_stream

# Number types by the mode of an MRC header.
MODES = {0: "i1", 1: "i2", 2: "f4", 4: "c8", 6: "u2", 12: "f2"}
_HEAD = "path string, nx int, ny int, nz int, mode int, apix double, apix_y double, apix_z double, extended int, low double, high double, mean double, is_volume boolean"


def _header(content: bytes) -> tuple[tuple, str]:
    """(values of _HEAD but the path, byte order)."""
    order = ">" if content[212:213] == b"\x11" else "<"
    nx, ny, nz, mode = struct.unpack(f"{order}4i", content[:16])
    mx, my, mz = struct.unpack(f"{order}3i", content[28:40])
    cell = struct.unpack(f"{order}3f", content[40:52])
    low, high, mean, group, extended = struct.unpack(f"{order}3f2i", content[76:96])
    size = [c / m if m else 0.0 for c, m in zip(cell, (mx, my, mz))]
    return (nx, ny, nz, mode, *size, extended, low, high, mean, group == 1 and nz > 1), order


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """A row of header values for each MRC file; files too short for a header are left out."""
    files = spark.read.format("binaryFile").load(path).select("path", F.substring("content", 1, 1024).alias("head"))

    def heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(p, *_header(bytes(h))[0]) for p, h in zip(part["path"], part["head"]) if len(h) >= 1024], columns=[c.split()[0] for c in _HEAD.split(", ")])

    return files.mapInPandas(heads, _HEAD)


def stack_images(spark: SparkSession, path: str) -> DataFrame:
    """A row for each image of each stack: rid, its place from 0, rlnImageName and rlnImagePixelSize."""
    heads = read_headers(spark, path).withColumn("rid", F.explode(F.sequence(F.lit(0), F.col("nz") - 1)))
    name = F.regexp_replace("path", "^file:/+", "/")
    return heads.select(F.col("rid").cast("long").alias("rid"), F.format_string("%06d@%s", F.col("rid") + 1, name).alias("rlnImageName"), F.col("apix").alias("rlnImagePixelSize"))


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(path, section, ny, nx, values) of every section of MRC files, values in order of row and column. One file is read in one task, section by section."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def sections(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"]):
                (nx, ny, nz, mode, _, _, _, extended, *_), order = _header(bytes(content[:1024]))
                kind = np.dtype(order + MODES[mode])
                for k in range(nz):
                    at = 1024 + extended + k * nx * ny * kind.itemsize
                    values = np.frombuffer(content, kind, nx * ny, at).astype(float)
                    yield pd.DataFrame({"path": [name], "section": [k], "ny": [ny], "nx": [nx], "values": [values]})

    return files.mapInPandas(sections, "path string, section int, ny int, nx int, values array<double>")


def read_beam_shifts(spark: SparkSession, path: str) -> DataFrame:
    """(movie, x, y) of each microscope XML file: the part of its name that names the movie, and the beam shift."""
    files = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("xml"))
    shift = "/MicroscopeImage/microscopeData/optics/BeamShift/*[local-name()='{}']"
    movie = F.regexp_extract("path", MOVIE, 1)
    return files.select(movie.alias("movie"), *[F.expr(f'xpath_double(xml, "{shift.format(name)}")').alias(axis) for name, axis in (("_x", "x"), ("_y", "y"))]).where("movie <> ''")


# Fixed value: the part of file names that a movie and its XML file share.
MOVIE = r"(FoilHole_\d{7,8}_Data_\d{6,8}_\d{6,8}_\d{8}_\d{6})"


def with_beam_shift(df: DataFrame, shifts: DataFrame, image: str) -> DataFrame:
    """df with beam_shift_x and beam_shift_y of the movie that a column names; an image without its XML file has null."""
    one = shifts.groupBy(F.col("movie").alias("_movie")).agg(F.first("x").alias("beam_shift_x"), F.first("y").alias("beam_shift_y"))
    return df.withColumn("_own", F.regexp_extract(image, MOVIE, 1)).join(one, F.col("_own") == F.col("_movie"), "left").drop("_own", "_movie")


def write_map(voxels: DataFrame, path: str, apix: float = 1.0, value: str = "value") -> None:
    """One MRC map of 32-bit floats from voxels (z, y, x from 0, and a value), written by as many tasks as the sections fill; voxels that are missing or null are 0.

    The header has the size, the voxel size and least, largest and mean value.
    """
    at = voxels.agg(*[F.max(c).alias(c) for c in ("z", "y", "x")], F.min(value).alias("low"), F.max(value).alias("high"), F.sum(value).alias("sum"), F.count(value).alias("n")).first()
    if at["z"] is None:
        raise ValueError("nothing to write")
    nz, ny, nx = (int(at[c]) + 1 for c in ("z", "y", "x"))
    missing = at["n"] < nz * ny * nx
    low, high = (min(at["low"], 0.0), max(at["high"], 0.0)) if missing and at["n"] else (at["low"] or 0.0, at["high"] or 0.0)
    all_ = voxels.sparkSession.range(nz).select(F.col("id").alias("_z"))
    cells = voxels.where(F.col(value).isNotNull()).groupBy("z", "y").agg(F.collect_list(F.struct(F.col("x").cast("int").alias("x"), F.col(value).cast("float").alias("v"))).alias("cells"))
    lines = all_.join(voxels.sparkSession.range(ny).select(F.col("id").alias("_y")), F.lit(True)).join(cells, (F.col("_z") == F.col("z")) & (F.col("_y") == F.col("y")), "left").select("_z", "_y", "cells")

    def encode(batch: pa.RecordBatch) -> bytes:
        out = np.zeros((batch.num_rows, nx), "<f4")
        for k, row in enumerate(batch.column("cells").to_pylist()):
            for cell in row or []:
                out[k, cell["x"]] = cell["v"]
        return out.tobytes()

    def head(rows: int) -> bytes:
        out = bytearray(1024)
        struct.pack_into("<10i", out, 0, nx, ny, nz, 2, 0, 0, 0, nx, ny, nz)
        struct.pack_into("<6f3i", out, 40, nx * apix, ny * apix, nz * apix, 90.0, 90.0, 90.0, 1, 2, 3)
        struct.pack_into("<3fi", out, 76, low, high, (at["sum"] or 0.0) / (nz * ny * nx), 1 if nz > 1 else 0)
        out[208:216] = b"MAP \x44\x44\x00\x00"
        return bytes(out)

    write_stream(lines, path, encode, head, ["_z", "_y"])
