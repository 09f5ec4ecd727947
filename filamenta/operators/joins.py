"""Lookups, semi-joins and range joins."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.optics import clean_micrograph, eman_astigmatism, file_stem, image_file


def name_key(name: Column, pattern: str | None = None) -> Column:
    """What file selections compare: the name without leading zeros, or the first group of a pattern in it; null where the pattern doesn't match, which never equals anything."""
    bare = F.regexp_replace(name, "^0+", "")
    return bare if pattern is None else F.when(bare.rlike(pattern), F.regexp_extract(bare, pattern, 1))


def select_by_name(df: DataFrame, other: DataFrame, column: str, other_column: str, pattern: str | None = None, keep: bool = True) -> DataFrame:
    """Rows whose name key other has (or, with keep False, lacks)."""
    keys = other.select(name_key(F.col(other_column), pattern).alias("_k")).where("_k is not null")
    return df.withColumn("_k", name_key(F.col(column), pattern)).join(keys, "_k", "left_semi" if keep else "left_anti").drop("_k")


def exposure_parameters(df: DataFrame, source: DataFrame, uid: str, group: str, columns: list[str]) -> DataFrame:
    """df with source's exposure group of the same uid (the least group less 1 if it lacks the uid), and that group's medians of columns in source; medians of all its rows where the group has none."""
    least = source.agg((F.min(group) - 1).alias("_least"))
    ids = source.groupBy(uid).agg(F.max(group).alias("_g"))
    medians = source.groupBy(F.col(group).alias("_g")).agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    whole = source.agg(*[F.median(c).alias(f"_w_{c}") for c in columns]).crossJoin(least)  # one row each
    joined = df.drop(group, *columns).join(ids, uid, "left").join(medians, "_g", "left").join(F.broadcast(whole))
    return joined.select(*[c for c in df.columns if c not in (group, *columns)], F.coalesce("_g", "_least").alias(group), *[F.coalesce(f"_m_{c}", f"_w_{c}").alias(c) for c in columns])


def same_axis(pairs: DataFrame, one: tuple[str, ...], other: tuple[str, ...], tolerance: float, match: str) -> DataFrame:
    """Of candidate pairs (match, quaternions w, x, y, z of both) those whose relative rotation turns the z axis by at most tolerance degrees; of one match's the pair that turns it least, ties by the other columns."""
    (a, b, c, d), (e, f, g, h) = ([F.col(n) for n in names] for names in (one, other))
    x, y = a * f - b * e + c * h - d * g, a * g - b * h - c * e + d * f
    z = 1 - 2 * (x * x + y * y)
    near = pairs.withColumn("_z", F.round(z, 12)).where(F.col("_z") >= math.cos(math.radians(tolerance)))
    return near.groupBy(match).agg(F.min(F.struct((-F.col("_z")).alias("_less"), *[c for c in pairs.columns if c != match])).alias("_p")).select(match, "_p.*").drop("_less")


def semi(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    return df.join(other.select(*keys), keys, "left_semi")


def anti_or_all(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows without a match; all rows if none is left."""
    rest = df.join(other.select(*keys), keys, "left_anti")
    return df if rest.isEmpty() else rest


def last_lookup(df: DataFrame, source: DataFrame, key: str, columns: list[str], rid: str) -> DataFrame:
    """df with columns overwritten by those of source's last row of the same key."""
    last = source.groupBy(key).agg(F.max_by(F.struct(*columns), rid).alias("_s"))
    return df.drop(*columns).join(last, key, "left").select(*[c for c in df.columns if c not in columns], *[F.col(f"_s.{c}").alias(c) for c in columns])


def group_mean_lookup(df: DataFrame, source: DataFrame, key: str, columns: list[str]) -> DataFrame:
    return df.drop(*columns).join(source.groupBy(key).agg(*[F.avg(c).alias(c) for c in columns]), key, "left")


def mean_ctf_lookup(df: DataFrame, source: DataFrame, key: str, u: str, v: str, angle: str, others: tuple[str, ...] = ()) -> DataFrame:
    """df with the CTF of source's rows of the same key: mean defocus, the mean vector of half the astigmatism along its angle, means of others; keys without rows keep theirs."""
    half = (F.col(v) - F.col(u)) / -2
    means = source.groupBy(key).agg(F.avg((F.col(u) + F.col(v)) / 2).alias("_d"), F.avg(half * F.cos(F.radians(angle))).alias("_x"), F.avg(half * F.sin(F.radians(angle))).alias("_y"), *[F.avg(c).alias(f"_o{k}") for k, c in enumerate(others)])
    length = F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))
    new = {u: F.col("_d") + length, v: F.col("_d") - length, angle: F.degrees(F.atan2("_y", "_x"))} | {c: F.col(f"_o{k}") for k, c in enumerate(others)}
    joined = df.join(means, key, "left")
    return joined.select(*[F.when(F.col("_d").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def copy_optics(optics: DataFrame, source: DataFrame, columns: tuple[str, ...] = ("rlnBeamTiltX", "rlnBeamTiltY", "rlnOddZernike", "rlnEvenZernike"), group: str = "rlnOpticsGroup") -> DataFrame:
    """optics with those of the columns that source has, from its row of the same group; groups that it lacks keep theirs, or get 0."""
    have = [c for c in columns if c in source.columns]
    other = source.select(F.col(group).alias("_g"), *[F.col(c).alias(f"_s_{c}") for c in have])
    joined = optics.join(other, F.col(group) == F.col("_g"), "left")
    kept = {c: F.col(c) if c in optics.columns else F.lit(0.0) for c in have}
    rest = [F.col(c) for c in optics.columns if c not in have]
    return joined.select(*rest, *[F.when(F.col("_g").isNotNull(), F.col(f"_s_{c}")).otherwise(kept[c]).alias(c) for c in have])


def set_ctf(df: DataFrame, ctf: DataFrame, image: str = "rlnImageName", detector: float = 5.0) -> DataFrame:
    """df with the CTF columns of a table (name, voltage, cs, ampcont in percent, apix, defocus and dfdiff in micrometres, dfang) by the stem of the image file, else by that up to its first dot; without a row they are null."""
    stem = file_stem(image_file(F.col(image)))
    values = F.struct("voltage", "cs", "ampcont", "apix", "defocus", "dfdiff", "dfang")
    one = ctf.select(F.col("name").alias("_one"), values.alias("_c1"))
    two = ctf.select(F.col("name").alias("_two"), values.alias("_c2"))
    rows = df.withColumn("_stem", stem).withColumn("_short", F.substring_index(stem, ".", 1))
    rows = rows.join(one, F.col("_stem") == F.col("_one"), "left").join(two, F.col("_short") == F.col("_two"), "left").withColumn("_c", F.coalesce("_c1", "_c2"))
    size = F.col("rlnDetectorPixelSize").cast("double") if "rlnDetectorPixelSize" in df.columns else F.lit(float(detector))
    u, v, angle = eman_astigmatism(F.col("_c.defocus"), F.col("_c.dfdiff"), F.col("_c.dfang"))
    new = {"rlnDetectorPixelSize": size, "rlnVoltage": F.col("_c.voltage"), "rlnSphericalAberration": F.col("_c.cs"), "rlnAmplitudeContrast": F.col("_c.ampcont") / 100.0, "rlnMagnification": size * 1e4 / F.col("_c.apix"), "rlnDefocusU": u, "rlnDefocusV": v, "rlnDefocusAngle": angle}
    return rows.select(*[c for c in df.columns if c not in new], *[value.alias(name) for name, value in new.items()])


def remapped_micrographs(df: DataFrame, names: DataFrame, micrograph: str = "rlnMicrographName") -> DataFrame:
    """df with micrograph paths of another table, found by the cleaned base name; of several the last in order; a name that it lacks stays."""
    known = names.groupBy(clean_micrograph(F.col(micrograph)).alias("_base")).agg(F.max(micrograph).alias("_path"))
    joined = df.withColumn("_own", clean_micrograph(F.col(micrograph))).join(known, F.col("_own") == F.col("_base"), "left")
    return joined.select(*[F.coalesce("_path", micrograph).alias(c) if c == micrograph else F.col(f"`{c}`") for c in df.columns])


def coalesced(df: DataFrame, other: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """df with columns of other's row of the same key where that has a value; other has a row a key."""
    joined = df.join(other.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns]), key, "left")
    return joined.select(*[F.coalesce(f"_o_{c}", c).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns], *[F.col(f"_o_{c}").alias(c) for c in columns if c not in df.columns])


def inner_by_uid(df: DataFrame, passthrough: DataFrame, uid: str = "uid") -> DataFrame:
    """Rows of both tables by uid; columns of both keep the values of the first."""
    return df.join(passthrough.select(uid, *[f"`{c}`" for c in passthrough.columns if c not in df.columns]), uid)


def intersected(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of both tables."""
    return df.select(*keys).intersect(other.select(*keys))


def subtracted(df: DataFrame, other: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of df whose keys other lacks; none is left if all are there."""
    return df.join(other.select(*keys), keys, "left_anti")


def same_fields(df: DataFrame, other: DataFrame) -> DataFrame:
    """Rows of both with the columns that both have, in df's order."""
    columns = [c for c in df.columns if c in other.columns]
    return df.select(*columns).unionByName(other.select(*columns))


def first_in_order(df: DataFrame, keys: list[str], rid: str) -> DataFrame:
    """The distinct keys in order of their first row, which stays as rid."""
    return df.groupBy(*keys).agg(F.min(rid).alias(rid))


def on_segment(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column, off: float = 1.0) -> Column:
    """Whether the way from a to b over the point is less than off longer than the straight one."""
    way = lambda px, py, qx, qy: F.sqrt((px - qx) * (px - qx) + (py - qy) * (py - qy))
    return F.abs(way(ax, ay, bx, by) - way(x, y, ax, ay) - way(x, y, bx, by)) < off


def filaments_along(part: DataFrame, full: DataFrame, partition: list[str], tube: str, x: str, y: str, rid: str, least: float = 0.0) -> DataFrame:
    """Rows of those filaments of full on whose line between first and last segment both ends of a filament of part lie, with at least that share of its rows.

    Filaments are one row each with their ends when they meet.
    """

    def ends(df: DataFrame, tag: str) -> DataFrame:
        point = F.struct(F.col(x).alias("x"), F.col(y).alias("y"))
        return df.groupBy(*partition, F.col(tube).alias(f"_{tag}")).agg(F.min_by(point, rid).alias(f"_{tag}a"), F.max_by(point, rid).alias(f"_{tag}b"), F.count("*").alias(f"_{tag}n"))

    pairs = ends(part, "p").join(ends(full, "f"), partition)
    c = F.col
    along = [on_segment(c(f"_p{e}.x"), c(f"_p{e}.y"), c("_fa.x"), c("_fa.y"), c("_fb.x"), c("_fb.y")) for e in "ab"]
    chosen = pairs.where(along[0] & along[1] & (c("_pn") / c("_fn") >= least)).select(*partition, c("_f").alias(tube)).distinct()
    return full.join(chosen, [*partition, tube], "left_semi")


def contained_in(df: DataFrame, name: str, patterns: DataFrame, out: str) -> DataFrame:
    """df with the value of the first pattern (rank, pattern, value; a row each) that the name contains, else 0.

    Each distinct name meets the patterns once; names are far fewer than rows.
    """
    names = df.select(F.col(name).alias("_name")).distinct()
    hits = names.join(patterns, F.contains("_name", F.col("pattern"))).groupBy("_name").agg(F.min_by("value", "rank").alias("_value"))
    return df.join(hits, F.col(name) == F.col("_name"), "left").withColumn(out, F.coalesce("_value", F.lit(0))).drop("_name", "_value")


def near_semi(df: DataFrame, other: DataFrame, partition: list[str], x: str, y: str, distance: float, rid: str, own: bool = True) -> DataFrame:
    """Rows of df with any row of other (without own: any of another rid) at most distance away in the same partition.

    Points fall into square cells of that size; other's rows go to the nine cells
    around them, so the join is an equality of cells with a distance check.
    """
    side = distance or 1.0
    cell = lambda c: F.floor(F.col(c) / side)
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    right = other.select(*partition, F.col(rid).alias("_rid"), F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_i", cell("_x")).withColumn("_j", cell("_y"))
    right = right.withColumn("_di", around).withColumn("_dj", around)
    right = right.select(*partition, "_rid", "_x", "_y", (F.col("_i") + F.col("_di")).alias("_ci"), (F.col("_j") + F.col("_dj")).alias("_cj"))
    left = df.withColumn("_ci", cell(x)).withColumn("_cj", cell(y)).alias("l")
    r = right.alias("r")
    same = [F.col(f"l.{c}") == F.col(f"r.{c}") for c in (*partition, "_ci", "_cj")]
    near = F.pow(F.col(f"l.{x}") - F.col("r._x"), 2) + F.pow(F.col(f"l.{y}") - F.col("r._y"), 2) <= distance * distance
    for s in same:
        near = near & s
    if not own:
        near = near & (F.col(f"l.{rid}") != F.col("r._rid"))
    return left.join(r, near, "left_semi").drop("_ci", "_cj")


def nearest_match(df: DataFrame, other: DataFrame, partition: list[str], x: str, y: str, distance: float, rid: str) -> DataFrame:
    """(rid, match, apart): for each row of df the nearest row of other at most distance away in the same partition; ties go to the smaller id.

    Cells as in near_semi; the best of a row's candidates is taken by aggregation.
    """
    side = distance or 1.0
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    left = df.select(*partition, F.col(rid).alias("rid"), F.col(x).alias("_px"), F.col(y).alias("_py"), F.floor(F.col(x) / side).alias("_ci"), F.floor(F.col(y) / side).alias("_cj"))
    right = other.select(*partition, F.col(rid).alias("match"), F.col(x).alias("_x"), F.col(y).alias("_y")).withColumn("_di", around).withColumn("_dj", around)
    right = right.withColumn("_ci", F.floor(F.col("_x") / side) + F.col("_di")).withColumn("_cj", F.floor(F.col("_y") / side) + F.col("_dj"))
    squared = F.pow(F.col("_px") - F.col("_x"), 2) + F.pow(F.col("_py") - F.col("_y"), 2)
    near = left.join(right, [*partition, "_ci", "_cj"]).withColumn("apart", F.sqrt(squared)).where(F.col("apart") <= distance)
    return near.groupBy("rid").agg(F.min(F.struct("apart", "match")).alias("b")).select("rid", F.col("b.match").alias("match"), F.col("b.apart").alias("apart"))


def recover_filaments(part: DataFrame, full: DataFrame, keys: list[str], least: float | None = None) -> DataFrame:
    """All rows of those filaments of full of which part holds at least that share.

    Without a share it is found: none is asked for where part holds at least half of the
    rows of its filaments, else the share that it holds of them.
    """
    have = part.groupBy(*keys).agg(F.count("*").alias("_have"))
    all_ = full.groupBy(*keys).agg(F.count("*").alias("_all"))
    chosen = have.join(all_, keys)
    if least is None:
        whole = chosen.agg((F.sum("_have") / F.sum("_all")).alias("_share"))
        whole = whole.select(F.when(F.col("_share") >= 0.5, 0.0).otherwise(F.col("_share")).alias("_least"))
        chosen = chosen.join(F.broadcast(whole), F.col("_have") / F.col("_all") >= F.col("_least"))  # one row
    else:
        chosen = chosen.where(F.col("_have") / F.col("_all") >= least)
    return full.join(chosen, keys, "left_semi")


def last_per_key(df: DataFrame, keys: list[str], rid: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(rid))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
