"""Shared plumbing of the training-data operators: shared-folder tables,
connected components, distributed ranks and Arrow text access.

Nothing here keeps state on the driver beyond what its docstring bounds.
"""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset, a local session gets a temporary one; a cluster is refused."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: it must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


_kept: weakref.WeakKeyDictionary[DataFrame, str] = weakref.WeakKeyDictionary()


def keep(df: DataFrame, label: str = "step") -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it back.

    Survives lost executors, because every executor sees the folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _kept[out] = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove the files of tables that keep() wrote and nothing will read again."""
    for df in tables:
        path = _kept.pop(df, None)
        if path:
            jvm, jsc = df.sparkSession._jvm, df.sparkSession.sparkContext._jsc
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(jsc.hadoopConfiguration()).delete(folder, True)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Send Python workers so many rows at once: rows here are whole texts, and the default of 10,000 may be gigabytes."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_held: dict[str, object] = {}


def held_for(operator: str, make: Callable[[], object]) -> object:
    """What a Python worker holds from task to task for one operator. That of the operator before goes, as workers outlive stages and share an executor's memory with its JVM."""
    if operator not in _held:
        _held.clear()
        _held[operator] = make()
    return _held[operator]


def giving_back(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A function of mapInArrow that ends by giving the system back what Arrow and the C library keep of freed memory, which else stays with the idle worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from task(batches)
        pa.default_memory_pool().release_unused()
        pa.system_memory_pool().release_unused()

    return run


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names, with underscores added until df has no column of that name in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(*names: str) -> list[str]:
    """Names of columns as select() takes them, dots and backticks included."""
    return ["`" + n.replace("`", "``") + "`" for n in names]


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def utf8_slices(texts: pa.Array, most_bytes: int = 1 << 19) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets from 0, bytes) of runs of rows with about most_bytes of UTF-8; one longer text is a run of its own. Null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    wide = pa.types.is_large_string(texts.type)
    _, at, data = texts.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most_bytes, "right")) - 1)
        end = min(end, len(texts))
        yield row, offsets[row : end + 1] - offsets[row], raw[offsets[row] : offsets[end]]
        row = end


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix), elementwise with wrap-around."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge; component is the smallest node that links reach.

    edges: columns a, b (long). Alternating large and small stars; every round is
    joins and aggregations and is written to the shared folder. A hub with many
    neighbours costs no more than its edges: minima are pre-aggregated, and the
    joins on hubs are sort-merge joins that AQE can split.
    """
    e = keep(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    seen = None
    while True:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = keep(large.where("u <> v"), "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        before, e = e, keep(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "small")
        discard(before, large)
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_003), F.sum(F.xxhash64("v", "u") % 1_000_033)).first()
        if now == seen:
            break
        seen = now
    leaves = e.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("node"), "component")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    out = keep(leaves.union(roots), "components")
    discard(e)
    return out


def ranked(df: DataFrame, group: str, order: Column, tie: list[str], rank: str, buckets: int = 1024) -> DataFrame:
    """df with a gapless rank from 0 (long) inside each value of group, without collecting a group in one task.

    order: a long column, already spread evenly (a hash) inside 0 .. buckets - 1; rows rank by it, then by tie.
    Only the counts of (group, bucket) are summed in one place; with a bounded number of groups these are bounded.
    """
    from pyspark.sql import Window

    df = df.withColumn("_bucket", order)
    counts = df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    starts = counts.withColumn("_start", F.sum("_n").over(Window.partitionBy(group).orderBy("_bucket")) - F.col("_n")).drop("_n")
    starts = starts.select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), "_start")
    inside = df.withColumn("_row", F.row_number().over(Window.partitionBy(group, "_bucket").orderBy(*tie)))
    joined = inside.join(starts, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn(rank, F.col("_start") + F.col("_row") - 1).drop("_group", "_b", "_bucket", "_start", "_row")
