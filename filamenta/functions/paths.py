"""File paths as Catalyst expressions; an index before @ stays before the path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _apart(name: Column) -> tuple[Column, Column]:
    """(index with its @, or nothing; path)."""
    return F.regexp_extract(name, r"^([^@]*@)?(.*)$", 1), F.regexp_extract(name, r"^([^@]*@)?(.*)$", 2)


def _steps(path: Column) -> Column:
    """The steps of an absolute path without empty ones, . and .. ."""
    step = lambda done, s: F.when((s == "") | (s == "."), done).when(s == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.array_append(done, s))
    return F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)


def _absolute(path: Column, base: str) -> Column:
    return F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))


def absolute(name: Column, base: str) -> Column:
    """From the root, without . and ..; a relative path begins at base."""
    index, path = _apart(name)
    return F.concat(index, F.lit("/"), F.array_join(_steps(_absolute(path, base)), "/"))


def relative(name: Column, start: str, base: str) -> Column:
    """From start on, with .. for each step back."""
    index, path = _apart(name)
    steps, own = _steps(_absolute(path, base)), [s for s in start.split("/") if s]
    same = F.lit(0)
    for k in range(len(own), 0, -1):
        same = F.when((same == 0) & (F.array_join(F.slice(steps, 1, k), "/") == "/".join(own[:k])), F.lit(k)).otherwise(same)
    back = F.array_repeat(F.lit(".."), F.lit(len(own)) - same)
    rest = F.slice(steps, same + 1, F.greatest(F.size(steps) - same, F.lit(0)))
    joined = F.array_join(F.concat(back, rest), "/")
    return F.concat(index, F.when(joined == "", F.lit(".")).otherwise(joined))


def shortest(name: Column, start: str, base: str) -> Column:
    """The shorter of the absolute and the relative path; the relative one if they are equally long."""
    a, r = absolute(name, base), relative(name, start, base)
    return F.when(F.length(a) < F.length(r), a).otherwise(r)


def converted(df: DataFrame, column: str, to: str, start: str, base: str, files: DataFrame | None = None) -> DataFrame:
    """df with the paths of a column as "absolute", "relative", "shortest" or "current" ones; with files (path), those of files that aren't there stay as they are.

    Distinct names are converted and looked up once and joined back.
    """
    if to == "current":
        return df
    new = {"absolute": lambda c: absolute(c, base), "real": lambda c: absolute(c, base), "relative": lambda c: relative(c, start, base), "shortest": lambda c: shortest(c, start, base)}[to]
    if files is None:
        return df.withColumn(column, new(F.col(column)))
    names = df.select(F.col(column).alias("_name")).distinct().withColumn("_file", absolute(_apart(F.col("_name"))[1], base))
    there = files.select(F.regexp_replace("path", "^file:/+", "/").alias("_file")).distinct()
    known = names.join(there, "_file").select("_name", new(F.col("_name")).alias("_new"))
    return df.join(known, F.col(column) == F.col("_name"), "left").withColumn(column, F.coalesce("_new", column)).drop("_name", "_new")


def resolved(df: DataFrame, column: str, files: DataFrame, folders: list[str], required: bool = True) -> DataFrame:
    """df with the path under which a file is there: as it is, or its whole or its base name, also as .mrcs for .mrc, under the first of folders that has it.

    files: (path) of what is there. A name that is nowhere stays, or with required is an error when rows are read.
    """
    there = files.select(F.regexp_replace("path", "^file:/+", "/").alias("_path")).distinct()
    names = df.select(F.col(column).alias("_name")).distinct()
    path = _apart(F.col("_name"))[1]
    base = F.element_at(F.split(path, "/"), -1)
    tries = [path, *[F.concat(F.lit(f.rstrip("/") + "/"), p) for f in folders for p in (path, base)]]
    tries = [t for p in tries for t in (p, F.regexp_replace(p, r"\.mrc$", ".mrcs"))]
    placed = names.select("_name", F.posexplode(F.array(*tries)).alias("_rank", "_try"))
    plain = placed.withColumn("_path", F.concat(F.lit("/"), F.array_join(_steps(F.col("_try")), "/"))).where(F.col("_try").startswith("/"))
    found = plain.join(there, "_path").groupBy("_name").agg(F.min_by("_path", "_rank").alias("_found"))
    joined = df.join(found, F.col(column) == F.col("_name"), "left")
    new = F.concat(_apart(F.col(column))[0], F.col("_found"))
    missing = F.raise_error(F.concat(F.lit("no file for "), F.col(column))) if required else F.col(column)
    return joined.withColumn(column, F.when(F.col("_found").isNotNull(), new).otherwise(missing)).drop("_name", "_found")
