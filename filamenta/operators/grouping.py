"""Dense ids and groups. Ids are computed on one row a key and joined back, so a hot key is no hot task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.optics import SOFTWARE, acquisition_time, beam_shift_label, time_text
from .clusters import ward_clusters
from .ranking import numbered, running_before


def first_seen_ids(df: DataFrame, keys: list[str], rid: str, name: str, start: int = 1) -> DataFrame:
    """Ids of keys in order of first appearance."""
    seen = df.groupBy(*keys).agg(F.min(rid).alias("_first"))
    return df.join(numbered(seen, ["_first"], name, start).drop("_first"), keys)


def sorted_ids(df: DataFrame, keys: list[str], name: str, start: int = 1) -> DataFrame:
    """Ids of keys in sorted order; for two keys that is the combination of two groupings."""
    return df.join(numbered(df.select(*keys).distinct(), keys, name, start), keys)


def reset(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn(name, F.lit(1))


def sync(df: DataFrame, primary: str, suffix: str) -> DataFrame:
    """Copies the primary id to every other column whose name ends so."""
    return df.withColumns({c: F.col(primary) for c in df.columns if c.endswith(suffix) and c != primary})


def _packer(size: int) -> Callable[[object, int], int]:
    """A function that takes the runs of one parent after the other, (parent, count), and gives each its group from 0."""
    now, group, held = None, 0, 0

    def step(key: object, n: int) -> int:
        nonlocal now, group, held
        if key != now:
            now, group, held = key, 0, 0
        if held and (held == size or held + n > size):
            group, held = group + 1, 0
        held += n
        return group

    return step


def packed_runs(values: list[tuple], size: int) -> list[int]:
    """Group numbers from 0 of sorted (value, count) runs: runs aren't split, a group closes when full or when the next run would overflow it, and a last group under half of size joins the one before."""
    step = _packer(size)
    out = [step(0, n) for _, n in values]
    if out and out[-1] > 0 and sum(n for (_, n), g in zip(values, out) if g == out[-1]) < size // 2:
        out = [min(g, out[-1] - 1) for g in out]
    return out


def packed_times(runs: DataFrame, parent: str, time: str, count: str, size: int) -> DataFrame:
    """(parent, time, group): sorted runs of count rows each, packed within each parent into groups of at most size from 0.

    Each task reads the sorted runs of its parents as a stream. A last group under half
    of size joins the one before.
    """

    def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        step = _packer(size)
        for part in parts:
            yield part.assign(_group=[step(key, n) for key, n in zip(part[parent].tolist(), part[count].tolist())])

    kinds = ", ".join(f"`{c}` {runs.schema[c].dataType.simpleString()}" for c in (parent, time, count))
    packed = runs.select(parent, time, count).repartition(F.col(f"`{parent}`")).sortWithinPartitions(parent, time).mapInPandas(pack, f"{kinds}, _group long")
    held = packed.groupBy(parent, "_group").agg(F.sum(count).alias("_held"))
    last = held.groupBy(parent).agg(F.max(F.struct("_group", "_held")).alias("_last"))
    small = (F.col("_last._held") < size // 2) & (F.col("_last._group") > 0)
    return packed.join(last, parent).select(parent, time, F.when(small, F.least("_group", F.col("_last._group") - 1)).otherwise(F.col("_group")).alias("group"))


def time_groups(df: DataFrame, parent: str, time: str, size: int, name: str, item: str | None = None) -> DataFrame:
    """Within each parent group, items (micrographs; by default times) are packed in order of time into groups of about size; ids run on from parent to parent.

    Items of one time stay together. A negative size first puts all parents together.
    """
    if size < 0:
        return time_groups(df.withColumn("_all", F.lit(1)), "_all", time, -size, name, item).drop("_all")
    if item is None:  # distinct times have no ties, so the group is the row's rank over size
        times = df.select(parent, time).distinct()
        last = F.floor((F.col("_n") - 1) / size)
        short = (F.col("_n") - last * size < size // 2) & (last > 0)
        groups = times.groupBy(parent).agg(F.count("*").alias("_n")).withColumn("_groups", last + 1 - short.cast("long"))
        groups = running_before(groups, [parent], F.col("_groups"), "_before").drop("_n")
        own = F.least(F.floor((F.row_number().over(Window.partitionBy(parent).orderBy(time)) - 1) / size), F.col("_groups") - 1)
        ids = times.join(groups, parent)
        return df.join(ids.select(parent, time, (own + F.col("_before") + 1).cast("long").alias(name)), [parent, time])
    runs = df.select(parent, time, item).distinct().groupBy(parent, time).agg(F.count("*").alias("_count"))
    packed = packed_times(runs, parent, time, "_count", size)
    groups = packed.groupBy(parent).agg((F.max("group") + 1).alias("_groups"))
    before = running_before(groups, [parent], F.col("_groups"), "_before").select(parent, "_before")
    ids = packed.join(before, parent).select(parent, time, (F.col("group") + F.col("_before") + 1).cast("long").alias(name))
    return df.join(ids, [parent, time])


def label_groups(df: DataFrame, image: str, software: str, name: str, per_stage_shift: int = 1, parent: str | None = None) -> DataFrame:
    """Groups by the beam shift label in file names: labels sorted and numbered from 1, within each parent group running on.

    Where serial numbers stand for labels, the group is the number modulo the images a
    stage shift (from 1; 0 for number 0). Software whose names hold no label is refused.
    """
    if not any(SOFTWARE[software][2:]):
        raise ValueError(f"names of {software} hold no beam shift")
    label = beam_shift_label(F.col(image), software)
    if not SOFTWARE[software][3]:
        k = label.cast("long")
        return df.withColumn(name, F.when(k > 0, (k - 1) % per_stage_shift + 1).otherwise(0).cast("int"))
    return sorted_ids(df.withColumn("_label", label), [*([parent] if parent else []), "_label"], name).drop("_label")


def cloned_optics(optics: DataFrame, ids: DataFrame, group: str = "rlnOpticsGroup") -> DataFrame:
    """The optics table of new groups: ids (old, new); each new group has the row of the group it came from, its own number and a name after it."""
    rest = [c for c in optics.columns if c not in (group, f"{group}Name")]
    return ids.distinct().join(optics, F.col("old") == F.col(group)).select(F.col("new").alias(group), F.concat(F.lit("opticsGroup"), F.col("new").cast("string")).alias(f"{group}Name"), *rest)


def optics_by_time(df: DataFrame, optics: DataFrame, image: str, size: int, group: str = "rlnOpticsGroup", software: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with new optics groups and rlnMovieCollectionTime, the optics table with a row for each): groups split by acquisition time."""
    timed = df.withColumn("_time", acquisition_time(F.col(image), software)).withColumn("rlnMovieCollectionTime", time_text(F.col("_time")))
    out = time_groups(timed, group, "_time", size, "_new", image)
    return out.drop(group, "_time").withColumnRenamed("_new", group), cloned_optics(optics, out.select(F.col(group).alias("old"), F.col("_new").alias("new")), group)


def optics_per_micrograph(df: DataFrame, optics: DataFrame, image: str, rid: str, group: str = "rlnOpticsGroup") -> tuple[DataFrame, DataFrame]:
    """(rows with an optics group for each image file in order of appearance, the optics table with a row for each)."""
    out = first_seen_ids(df, [image], rid, "_new")
    return out.drop(group).withColumnRenamed("_new", group), cloned_optics(optics, out.select(F.col(group).alias("old"), F.col("_new").alias("new")), group)


def optics_by_label(df: DataFrame, optics: DataFrame, image: str, software: str, group: str = "rlnOpticsGroup", per_stage_shift: int = 1) -> tuple[DataFrame, DataFrame]:
    """(rows with optics groups split by beam shift label, the optics table with a row for each)."""
    out = label_groups(df, image, software, "_label_group", per_stage_shift)
    out = sorted_ids(out, [group, "_label_group"], "_new").drop("_label_group")
    return out.drop(group).withColumnRenamed("_new", group), cloned_optics(optics, out.select(F.col(group).alias("old"), F.col("_new").alias("new")), group)


def one_optics_group(df: DataFrame, optics: DataFrame, group: str = "rlnOpticsGroup") -> tuple[DataFrame, DataFrame]:
    """(rows of group 1, the first optics row as group 1)."""
    first = optics.orderBy(group).limit(1)
    return df.withColumn(group, F.lit(1)), first.withColumn(group, F.lit(1)).withColumn(f"{group}Name", F.lit("opticsGroup1"))


def propagate_medians(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    medians = df.groupBy(group).agg(*[F.median(c).alias(c) for c in columns])
    return df.drop(*columns).join(medians, group)


def propagate_vector_medians(df: DataFrame, group: str, columns: list[str]) -> DataFrame:
    """df with every element of array columns replaced by the median of all elements of its group."""
    for c in columns:
        medians = df.select(group, F.explode(c).alias("_v")).groupBy(group).agg(F.median("_v").alias("_m"))
        df = df.join(medians, group, "left").withColumn(c, F.transform(c, lambda v: F.col("_m"))).drop("_m")
    return df


def build_optics(df: DataFrame, columns: list[str], rid: str) -> tuple[DataFrame, DataFrame]:
    """(rows with optics_group and without the optics columns, the optics table)."""
    numbered = first_seen_ids(df, columns, rid, "optics_group")
    optics = numbered.select("optics_group", *columns).distinct()
    return numbered.drop(*columns), optics


def dissolve_optics(df: DataFrame, optics: DataFrame, key: str = "optics_group") -> DataFrame:
    """df with the columns of its optics row. A group that the optics table lacks is an error when rows are read; a null group has nulls."""
    known = df.join(optics.withColumn("_known", F.lit(True)), key, "left")
    missing = F.col(key).isNotNull() & F.col("_known").isNull()
    return known.withColumn(key, F.when(missing, F.raise_error(F.concat(F.lit("no optics group "), F.col(key).cast("string")))).otherwise(F.col(key))).drop("_known")


def shift_clusters(df: DataFrame, x: str, y: str, name: str, least: int = 4, clusters: range = range(2, 200), item: str | None = None) -> DataFrame:
    """df with the number of the Ward cluster (from 1) of each row's beam shift (x, y), of the cut with the best silhouette; clusters under `least` items are dealt to their neighbours.

    item: a column (micrographs) each value of which counts once, with one place; by default every row counts.
    """
    if item is None:
        return ward_clusters(df, x, y, name, least, clusters)
    places = df.groupBy(item).agg(F.min(F.struct(x, y)).alias("_at")).select(item, F.col(f"_at.{x}").alias(x), F.col(f"_at.{y}").alias(y))
    return df.join(ward_clusters(places, x, y, name, least, clusters).select(item, name), item, "left")


def optics_by_shift(df: DataFrame, optics: DataFrame, image: str, x: str, y: str, group: str = "rlnOpticsGroup", least: int = 4, clusters: range = range(2, 200)) -> tuple[DataFrame, DataFrame]:
    """(rows with optics groups split by clusters of beam shifts, the optics table with a row for each). An image without a shift keeps its group apart from the clusters."""
    out = shift_clusters(df, x, y, "_cluster", least, clusters, image).withColumn("_cluster", F.coalesce("_cluster", F.lit(0)))
    out = sorted_ids(out, [group, "_cluster"], "_new").drop("_cluster")
    return out.drop(group).withColumnRenamed("_new", group), cloned_optics(optics, out.select(F.col(group).alias("old"), F.col("_new").alias("new")), group)


def exposure_groups_by_shift(df: DataFrame, group: str, image: str, x: str, y: str, medians: list[str], suffix: str = "exp_group_id", least: int = 4, clusters: range = range(2, 200)) -> DataFrame:
    """df with exposure groups split by clusters of beam shifts, copied to every other column whose name ends in suffix; columns of medians become those of their new group."""
    out = shift_clusters(df, x, y, "_cluster", least, clusters, image).withColumn("_cluster", F.coalesce("_cluster", F.lit(0)))
    out = sorted_ids(out, [group, "_cluster"], "_new").drop(group, "_cluster").withColumnRenamed("_new", group)
    return propagate_medians(sync(out, group, suffix), group, medians).select(*df.columns)
