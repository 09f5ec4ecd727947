"""Structured-array exports (.cs) and dispatch over file formats.

Spark reads the files as binary, a file a row, so any path that Spark reads works.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.grouping import dissolve_optics
from ..operators.ranking import numbered
from .databases import read_refinement
from .maps import stack_images
from .star import read_star, read_star_tables, write_star_file
from .star_source import opened
from .streams import write_stream

#: Rows that a task hands over at once.
SLICE = 10_000


def _kind(kind: np.dtype) -> str:
    base, shape = (kind.subdtype[0], kind.subdtype[1]) if kind.subdtype else (kind, ())
    name = {"f": "double", "i": "long", "u": "long", "b": "boolean"}.get(base.kind, "string")
    return f"array<{name}>" if shape else name


def _values(column: np.ndarray) -> list:
    """Python values; unsigned 64-bit ids keep their bits as signed ones, inner shapes are flattened."""
    if column.dtype == np.uint64:
        column = column.view(np.int64)
    if column.ndim > 1:
        return column.reshape(len(column), -1).tolist()
    return [v.decode() if isinstance(v, bytes) else v for v in column.tolist()]


def _read(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").load(path)

    def heads(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for content in part["content"]:
                fields = np.load(io.BytesIO(content)).dtype.fields
                yield pd.DataFrame([(name, _kind(f[0]), k) for k, (name, f) in enumerate(fields.items())], columns=["name", "kind", "place"])

    found = files.select("content").mapInPandas(heads, "name string, kind string, place int")
    columns = found.groupBy("name").agg(F.min("kind").alias("kind"), F.min("place").alias("place")).orderBy("place", "name").collect()  # one row a column
    if not columns:
        raise ValueError(f"no table in {path}")
    columns = [r for r in columns if r["name"] not in ("file", "rid")]  # the place in the file is the row's id
    names = [r["name"] for r in columns]

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for file, content in zip(part["path"], part["content"]):
                table = np.load(io.BytesIO(content))
                for a in range(0, len(table), SLICE):
                    cut = table[a : a + SLICE]
                    data = {n: _values(cut[n]) if n in cut.dtype.names else [None] * len(cut) for n in names}
                    yield pd.DataFrame({"file": file, "rid": np.arange(a, a + len(cut)), **data})

    schema = "file string, rid long, " + ", ".join(f"`{r['name']}` {r['kind']}" for r in columns)
    return files.select("path", "content").mapInPandas(rows, schema)


def passthrough_of(spark: SparkSession, path: str) -> str | None:
    """The passthrough table in the folder of an export: that of its own name for particles_..., else that of all particles; None if there is none."""
    folder, _, name = path.rpartition("/")
    glob = f"{folder}/*J[0-9]*_passthrough_{name if name.startswith('particles_') else 'particles.cs'}"
    jvm = spark._jvm.org.apache.hadoop.fs
    found = jvm.Path(glob).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(jvm.Path(glob))
    return min(str(f.getPath()) for f in found) if found else None


def read_export(spark: SparkSession, path: str, passthrough: str | None = None, discover: bool = False) -> DataFrame:
    """Rows of structured .npy tables with file and rid, their place in it from 0.

    passthrough: tables whose further columns are joined by uid; columns of both keep
    the values of the first, rows without a partner stay. With discover they are looked
    for beside the export.
    """
    df = _read(spark, path)
    passthrough = passthrough or (passthrough_of(spark, path) if discover else None)
    if passthrough:
        more = _read(spark, passthrough)
        fresh = [c for c in more.columns if c not in df.columns]
        df = df.join(more.dropDuplicates(["uid"]).select("uid", *[F.col(f"`{c}`") for c in fresh]), "uid", "left")
    return df.drop("ctf/type")


def read_tables(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The union by name of STAR, CSV, Parquet and structured files; source numbers the paths from 0, columns that a file lacks are null."""

    def one(path: str) -> DataFrame:
        if path.endswith(".star"):
            return read_star(spark, path)
        if path.endswith(".csv"):
            return spark.read.csv(path, header=True, inferSchema=True)
        if path.endswith(".cs"):
            return read_export(spark, path).drop("file")
        if path.endswith(".parquet"):
            return spark.read.parquet(path)
        if path.endswith(".db"):
            return read_refinement(spark, path)
        if path.endswith((".mrc", ".mrcs")):
            return stack_images(spark, path)
        raise ValueError(f"no reader for {path}")

    if not paths:
        raise ValueError("no paths")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p).withColumn("source", F.lit(k)) for k, p in enumerate(paths)])


def read_tables_with_optics(spark: SparkSession, paths: list[str], group: str = "rlnOpticsGroup") -> tuple[DataFrame, DataFrame | None]:
    """(read_tables() of the paths, the union of their optics tables or None). As files count their groups on their own, groups of several files are numbered anew, in order of file and number; source tells the file in both."""
    rows, tables = [], []
    for k, path in enumerate(paths):
        own, optics = read_star_tables(spark, path) if path.endswith(".star") else (read_tables(spark, [path]).drop("source"), None)
        rows.append(own.withColumn("source", F.lit(k)))
        if optics is not None:
            tables.append(optics.drop("rid").withColumn("source", F.lit(k)))
    if not rows:
        raise ValueError("no paths")
    union = lambda parts: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    data, optics = union(rows), union(tables) if tables else None
    if optics is None or len(paths) == 1 or group not in data.columns:
        return data, optics
    known = data.where(F.col(group).isNotNull()).select("source", F.col(group).cast("long").alias(group)).union(optics.select("source", F.col(group).cast("long"))).distinct()
    ids = numbered(known, ["source", group], "_new")
    renumber = lambda df: df.withColumn(group, F.col(group).cast("long")).join(F.broadcast(ids), ["source", group], "left").drop(group).withColumnRenamed("_new", group)  # noqa: E731  a row a group
    return renumber(data), renumber(optics)


def write_export(df: DataFrame, path: str, one_file: bool = False, order: list[str] | None = None) -> None:
    """A folder of structured .npy tables (.cs), one a task, or with one_file a single table in the order of columns, which many tasks write.

    Strings are as long as the longest of the column, arrays as the longest of theirs.
    A null string is empty, a null float NaN, a null array or a shorter one is filled up
    with NaN or 0; a null whole number or boolean is an error, as the format has none.
    The file system must be one that pyarrow opens.
    """
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    plain = {"double": "f8", "float": "f4", "bigint": "i8", "int": "i4", "smallint": "i2", "tinyint": "i1", "boolean": "?"}
    bad = [n for n, k in kinds.items() if k != "string" and k not in plain and not (k.startswith("array<") and k[6:-1] in plain)]
    if bad:
        raise ValueError(f"columns without a type in the format: {', '.join(bad)}")
    whole = [n for n, k in kinds.items() if k in plain and k not in ("double", "float")]
    looked = [F.max(F.octet_length(f"`{n}`") if k == "string" else F.size(f"`{n}`")).alias(f"w{i}") for i, (n, k) in enumerate(kinds.items()) if k == "string" or k.startswith("array")]
    looked += [F.count_if(F.col(f"`{n}`").isNull()).alias(f"n{i}") for i, n in enumerate(kinds) if n in whole]
    found = df.agg(*looked).first().asDict() if looked else {}
    null = [n for i, n in enumerate(kinds) if found.get(f"n{i}")]
    if null:
        raise ValueError(f"null whole numbers, which the format can't hold, in {', '.join(null)}")
    width = lambda i: max(1, found[f"w{i}"] or 1)
    kind = np.dtype([(n, f"S{width(i)}") if k == "string" else (n, plain[k[6:-1]], (width(i),)) if k.startswith("array") else (n, plain[k]) for i, (n, k) in enumerate(kinds.items())])
    names = [f"c{i}" for i in range(len(kinds))]  # whatever the columns are called

    def table_of(batch: pa.RecordBatch) -> np.ndarray:
        table = np.zeros(batch.num_rows, kind)
        for name, short in zip(kinds, names):
            column, field = batch.column(short), kind[name]
            if field.kind == "S":
                table[name] = [b"" if v is None else v.encode() for v in column.to_pylist()]
            elif field.subdtype:
                fill = np.nan if field.base.kind == "f" else 0
                for k, v in enumerate(column.to_pylist()):
                    row = [fill if x is None else x for x in v or []]
                    table[name][k] = row + [fill] * (field.shape[0] - len(row))
            else:
                table[name] = column.to_numpy(zero_copy_only=False)
        return table

    rows = df.select(*[F.col(f"`{n}`").alias(short) for n, short in zip(kinds, names)])
    if one_file:
        sort = [names[list(kinds).index(c)] for c in (order or list(kinds)[:1])]
        write_stream(rows, path, lambda batch: table_of(batch).tobytes(), lambda n: _npy_head(kind, n), sort)
        return

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(path)
        system.create_dir(root, recursive=True)
        task, parts = TaskContext.get(), [table_of(b) for b in batches]
        if parts:
            table = np.concatenate(parts)
            name = f"{root}/part-{task.partitionId():05d}.cs"
            with system.open_output_stream(f"{name}.{task.taskAttemptId()}.tmp", compression=None) as sink:
                sink.write(_npy_head(kind, len(table)) + table.tobytes())
            system.move(f"{name}.{task.taskAttemptId()}.tmp", name)
            yield pa.RecordBatch.from_pydict({"path": [name]})

    rows.mapInArrow(write, "path string").count()


def _npy_head(kind: np.dtype, rows: int) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array_header_1_0(out, {"descr": np.lib.format.dtype_to_descr(kind), "fortran_order": False, "shape": (rows,)})
    return out.getvalue()


def write_table(df: DataFrame, path: str, optics: DataFrame | None = None, order: str = "rid") -> None:
    """The table by the suffix of its path: .oldformat.star (optics columns in the rows), .star, .cs, .csv or .parquet; an empty table is refused."""
    if df.isEmpty():
        raise ValueError(f"nothing to write to {path}")
    if path.endswith(".oldformat.star"):
        write_star_file(dissolve_optics(df, optics, "rlnOpticsGroup") if optics is not None else df, path, block="", order=order)
    elif path.endswith(".star"):
        write_star_file(df, path, optics, order=order)
    elif path.endswith(".cs"):
        write_export(df, path, True, [order] if order in df.columns else None)
    elif path.endswith(".csv"):
        df.write.csv(path, header=True)
    elif path.endswith(".parquet"):
        df.write.parquet(path)
    else:
        raise ValueError(f"no writer for {path}")
