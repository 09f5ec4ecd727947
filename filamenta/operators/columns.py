"""Operators on columns. Missing columns are left out without an error where the docstring says so."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def add(df: DataFrame, column: str, x: float) -> DataFrame:
    return df.withColumn(column, F.col(column) + F.lit(float(x)))


def multiply(df: DataFrame, column: str, x: float) -> DataFrame:
    return df.withColumn(column, F.col(column) * F.lit(float(x)))


def typed(text: str):
    """The int, else float, else string that a text stands for."""
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def set_value(df: DataFrame, column: str, text: str) -> DataFrame:
    value = typed(text)
    return df.withColumn(column, F.lit(value).cast("long") if isinstance(value, int) else F.lit(value))


def duplicate(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Copies of columns; pairs whose source is missing or whose target exists are left out."""
    return df.withColumns({b: F.col(a) for a, b in pairs.items() if a in df.columns and b not in df.columns})


def rename(df: DataFrame, pairs: dict[str, str]) -> DataFrame:
    return df.withColumnsRenamed({a: b for a, b in pairs.items() if a in df.columns and b not in df.columns})


def delete(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*[c.lstrip("_") for c in columns])


def keep_only(df: DataFrame, *columns: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c in columns])


def replace_text(df: DataFrame, column: str, old: str, new: str) -> DataFrame:
    """Literal replacement."""
    return df.withColumn(column, F.replace(F.col(column), F.lit(old), F.lit(new)))


def change_pixel_size(df: DataFrame, apix: float, size: str = "apix", defocus=("defocus_u", "defocus_v"), cs: str = "cs") -> DataFrame:
    """Defocus scales with the square and spherical aberration with the fourth power of the ratio."""
    r = F.lit(float(apix)) / F.col(size)
    scaled = {d: F.col(d) * r * r for d in defocus} | {cs: F.col(cs) * r * r * r * r, size: F.lit(float(apix))}
    return df.withColumns(scaled)


def preferred_first(df: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns of a list that df has, in its order, then all others."""
    return df.select(*[c for c in columns if c in df.columns], *[f"`{c}`" for c in df.columns if c not in columns])


def pixel_size(df: DataFrame, optics: DataFrame | None = None, names: tuple[str, ...] = ("rlnMicrographPixelSize", "rlnMicrographOriginalPixelSize", "rlnImagePixelSize")) -> tuple[float, str] | None:
    """(value, column) of the first of these columns that the optics table has, else the rows; from the first row with a value."""
    for source in (optics, df):
        for c in names if source is not None else ():
            if c in source.columns:
                row = source.where(F.col(c).isNotNull()).select(F.col(c).cast("double")).first()
                if row:
                    return row[0], c
    return None


def set_optics_value(df: DataFrame, optics: DataFrame | None, column: str, text: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows, optics) with the value set in the optics table if that has the column, else in the rows."""
    if optics is not None and column in optics.columns:
        return df, set_value(optics, column, text)
    return set_value(df, column, text), optics


def stacks_by_suffix(df: DataFrame, image: str = "rlnImageName") -> DataFrame:
    """df with images in .mrc files named as stacks (.mrcs)."""
    return df.withColumn(image, F.regexp_replace(image, r"\.mrc$", ".mrcs"))


def full_stack(df: DataFrame, sizes: DataFrame, image: str = "rlnImageName", rid: str = "rid", keep: tuple[str, ...] = ("rlnVoltage", "rlnDefocusU", "rlnDefocusV", "rlnDefocusAngle", "rlnSphericalAberration", "rlnDetectorPixelSize", "rlnMagnification", "rlnAmplitudeContrast", "rlnMicrographName", "rlnGroupName", "rlnGroupNumber")) -> DataFrame:
    """All images of each stack that df names, numbered from 1, with the CTF columns of its first row; sizes: (file, n)."""
    columns = [c for c in keep if c in df.columns]
    first = df.groupBy(F.element_at(F.split(image, "@"), -1).alias("file")).agg(F.min_by(F.struct(F.lit(1).alias("_"), *columns), rid).alias("_c"))
    slices = first.join(sizes, "file").withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return slices.select(F.format_string("%06d@%s", "k", "file").alias(image), *[F.col(f"_c.{c}").alias(c) for c in columns])


def recentred(df: DataFrame, x: str, y: str, shift_x: str, shift_y: str, apix: Column) -> DataFrame:
    """df with coordinates moved by the whole pixels of its shifts in angstrom, and the rest of the shifts."""
    out = df
    for at, shift in ((x, shift_x), (y, shift_y)):
        whole = F.rint(F.col(shift) / apix)
        out = out.withColumn(at, F.col(at) - whole).withColumn(shift, F.col(shift) - whole * apix)
    return out


def with_created_time(df: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """df with the time of each file that the column names, as <column>CreateTime; files: (path, modificationTime), as Spark lists them. An unknown file has null."""
    times = files.select(F.regexp_replace("path", "^file:/+", "/").alias("_path"), F.col("modificationTime").alias(f"{column}CreateTime"))
    named = df.withColumn("_file", F.element_at(F.split(column, "@"), -1))
    return named.join(times.dropDuplicates(["_path"]), F.col("_file") == F.col("_path"), "left").drop("_file", "_path")


def set_pixel_size(df: DataFrame, optics: DataFrame | None, apix: float, defocus: tuple[str, ...] = (), names: tuple[str, ...] = ("rlnMicrographPixelSize", "rlnMicrographOriginalPixelSize", "rlnImagePixelSize")) -> tuple[DataFrame, DataFrame | None]:
    """(rows, optics) with a new pixel size in the column that pixel_size() finds, wherever it is; columns of defocus scale with the square of the ratio. Without any such column both stay as they are."""
    found = pixel_size(df, optics, names)
    if found is None:
        return df, optics
    ratio, column = float(apix) / found[0], found[1]
    df = df.withColumns({c: F.col(c) * ratio * ratio for c in defocus if c in df.columns})
    put = lambda t: t.withColumn(column, F.lit(float(apix))) if t is not None and column in t.columns else t
    return put(df), put(optics)


def free_name(df: DataFrame, name: str) -> str:
    """The name, or with the first number from 2 on that makes it a column that df lacks."""
    k, free = 1, name
    while free in df.columns:
        k += 1
        free = f"{name}{k}"
    return free


def names_with(df: DataFrame, text: str) -> list[str]:
    """The columns whose names hold a text, in order."""
    return [c for c in df.columns if text in c]


def first_name(df: DataFrame, names: list[str]) -> str | None:
    """The first of a list of names that is a column."""
    return next((c for c in names if c in df.columns), None)


def sort_keys(df: DataFrame, columns: list[str], image: str, descending: bool = False) -> list[Column]:
    """Orders by columns, nulls last; the image column by its file, then its number. A column that df lacks is an error."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"no column {', '.join(missing)}")
    parts = [p for c in columns for p in ((F.element_at(F.split(c, "@"), -1), F.element_at(F.split(c, "@"), 1)) if c == image else (F.col(f"`{c}`"),))]
    return [F.desc_nulls_last(p) if descending else F.asc_nulls_last(p) for p in parts]


def storage(df: DataFrame, headers: DataFrame, image: str = "rlnImageName") -> DataFrame:
    """(images, files, bytes): rows that name an image, their files, and the bytes that their images take at four a pixel; headers: (file, nx, ny). A file without a header adds no bytes."""
    files = df.groupBy(F.element_at(F.split(image, "@"), -1).alias("file")).agg(F.count(image).alias("_n")).where("file is not null")
    sized = files.join(headers.select("file", (F.col("nx").cast("long") * F.col("ny") * 4).alias("_b")), "file", "left")
    return sized.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("images"), F.count("*").alias("files"), F.coalesce(F.sum(F.col("_n") * F.col("_b")), F.lit(0)).alias("bytes"))
