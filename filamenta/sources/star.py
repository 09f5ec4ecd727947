"""STAR tables: one loop_ block as a DataFrame, and back to text files. Files are read by ranges of bytes, see star_source."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .star_source import PLACE, SPLIT, chosen_block, star_frame, star_index
from .streams import write_stream

_TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|[^\s#]\S*")
#: Columns that are whole numbers; all others are floating point where every value is.
WHOLE = frozenset("rlnRandomSubset rlnClassNumber rlnHelicalTubeID rlnOpticsGroup rlnImageSize rlnGroupNumber".split())


def loops(text: str) -> Iterator[tuple[str, list[str], list[list[str]]]]:
    """(block, columns, rows) of each loop_ of a STAR text."""
    block, columns, rows, state = "", [], [], ""
    for line in [*text.splitlines(), "data_"]:
        line = line.strip()
        if line.startswith("data_") or line == "loop_":
            if columns and rows:
                yield block, columns, rows
            if line.startswith("data_"):
                block = line[5:]
            columns, rows, state = [], [], "loop" if line == "loop_" else ""
        elif not line or line.startswith("#"):
            continue
        elif state == "loop" and line.startswith("_"):
            columns.append(line[1:].split()[0])
        elif state == "loop":
            rows.append([t.strip("'\"") for t in _TOKEN.findall(line)])


def read_star(spark: SparkSession, path: str, block: str | None = None, split: int = SPLIT) -> DataFrame:
    """Rows of a block (the first of BLOCKS that the file has) with rid, their place in it from 0; rows with a missing value are dropped.

    Tasks read ranges of `split` bytes: one pass counts the rows of each range and finds
    the columns whose every value is a number, another reads them typed.
    """
    index = star_index(spark, path, split)
    for file, places in json.loads(index).items():
        names = [n for _, n in places]
        if chosen_block(names, block) not in names:
            raise ValueError(f"no block {block or 'at all'} in {file}")
    raw = star_frame(spark, path, block, split=split, index=index)
    columns = [c for c in raw.columns if c not in PLACE]
    looked = raw.groupBy("file", "part").agg(F.count("*").alias("n"), *[F.bool_and(F.col(f"`{c}`").isNull() | F.col(f"`{c}`").try_cast("double").isNotNull()).alias(c) for c in columns]).collect()  # a row a range
    kinds = {c: "long" if c in WHOLE else "double" if all(r[c] is not False for r in looked) else "string" for c in columns}
    before, sums = [], {}
    for r in sorted(looked, key=lambda r: (r["file"], r["part"])):
        before.append((r["file"], r["part"], sums.get(r["file"], 0)))
        sums[r["file"]] = sums.get(r["file"], 0) + r["n"]
    starts = spark.createDataFrame(before, "file string, part long, before long")
    typed = star_frame(spark, path, block, schema="file string, part long, row long" + "".join(f", `{c}` {k}" for c, k in kinds.items()), split=split, index=index)
    out = typed.join(F.broadcast(starts), ["file", "part"])  # a row a range
    return out.select((F.col("before") + F.col("row")).alias("rid"), *[F.col(f"`{c}`") for c in columns]).na.drop("any")


def write_star(df: DataFrame, path: str, block: str = "particles", order: str = "rid") -> None:
    """A folder of STAR text in order of a column: a head file of column names, then part files, which read in name order are one table."""
    columns = [c for c in df.columns if c != order]
    shown, head = _shown(df, columns), _head(block, columns)
    body = df.repartitionByRange(F.col(order)).sortWithinPartitions(order).select(F.concat_ws("\t", *shown).alias("value"))
    df.sparkSession.createDataFrame([(head,)], "value string").coalesce(1).write.text(f"{path}/0-head")
    body.write.text(f"{path}/1-rows")


def read_star_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows, optics table or None) of a STAR file."""
    blocks = {name for places in json.loads(star_index(spark, path)).values() for _, name in places}
    return read_star(spark, path), read_star(spark, path, "optics") if "optics" in blocks else None


def _shown(df: DataFrame, columns: list[str]) -> list[Column]:
    """Values as text: floats to six digits, null and NaN as nan, null strings as None, and quoted what wouldn't be read back as one word."""
    out = []
    for c in columns:
        x, kind = F.col(f"`{c}`"), df.schema[c].dataType.simpleString()
        if kind in ("double", "float"):
            out.append(F.coalesce(F.when(F.isnan(x), "nan").otherwise(F.round(x, 6).cast("string")), F.lit("nan")))
        elif kind == "string":
            clean = F.regexp_replace(x, r"[\r\n]", " ")
            quote = F.when(clean.contains("'"), F.lit('"')).otherwise(F.lit("'"))
            odd = (clean == "") | clean.rlike(r"[\s#]|^['\"]|^data_|^loop_$|^_")
            out.append(F.coalesce(F.when(odd, F.concat(quote, clean, quote)).otherwise(clean), F.lit("None")))
        else:
            out.append(F.coalesce(x.cast("string"), F.lit("nan")))
    return out


def _head(block: str, columns: list[str]) -> str:
    return f"data_{block}\n\nloop_\n" + "\n".join(f"_{c} #{k}" for k, c in enumerate(columns, 1))


def write_star_file(df: DataFrame, path: str, optics: DataFrame | None = None, block: str | None = None, order: str = "rid") -> None:
    """One STAR file of the columns named rln..., in order of a column, after the optics table; as many tasks write it as the rows fill.

    The block is micrographs for rows without images, else particles. Nulls are nan in
    numeric columns and None in others; a path that exists is replaced.
    """
    columns = [c for c in df.columns if c.startswith("rln")]
    if not columns or df.isEmpty():
        raise ValueError("nothing to write")
    block = block if block is not None else "particles" if "rlnImageName" in columns or "rlnMicrographName" not in columns else "micrographs"
    head = ""
    if optics is not None:
        names = [c for c in optics.columns if c.startswith("rln")]
        lines = optics.orderBy("rlnOpticsGroup" if "rlnOpticsGroup" in names else names[0]).select(F.concat_ws("\t", *_shown(optics, names)).alias("line")).collect()  # a row a group
        head = "# version 30001\n\n" + _head("optics", names) + "\n" + "".join(r["line"] + "\n" for r in lines) + "\n"
    head = f"{head}\n{_head(block, columns)}\n".encode()
    rows = df.select(F.col(f"`{order}`").alias("at"), F.concat_ws("\t", *_shown(df, columns)).alias("line"))

    def encode(batch: pa.RecordBatch) -> bytes:
        return "".join(line + "\n" for line in batch.column("line").to_pylist()).encode()

    write_stream(rows, path, encode, lambda n: head, ["at", "line"])


def write_star_by(df: DataFrame, path: str, column: str, order: str = "rid") -> None:
    """A folder with a STAR table of parts for each value of a column (micrograph or subset)."""
    columns = [c for c in df.columns if c not in (order, column)]
    head = df.select(column).distinct().select(column, F.lit(-1).cast("long").alias("_at"), F.lit(_head("particles", columns)).alias("value"))
    body = df.select(column, F.col(order).cast("long").alias("_at"), F.concat_ws("\t", *_shown(df, columns)).alias("value"))
    rows = head.union(body).repartition(F.col(f"`{column}`")).sortWithinPartitions(column, "_at")
    rows.select(column, "value").write.partitionBy(column).text(path)
