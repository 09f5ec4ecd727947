"""One file from many tasks: tasks write parts, their lengths become places by a running sum, and the parts are put together in order.

A task writes its part under a name of its attempt and only tells of it when it is
whole, so a task that is retried or run twice leaves nothing in the file. On a
file system that joins files by itself (HDFS) the parts are joined there; on one that
writes at any place (local and mounted ones) tasks copy the parts to their places.
The file appears under its name when it is whole.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .star_source import opened

#: Bytes that a task copies at once.
CHUNK = 8 << 20


def write_stream(df: DataFrame, path: str, encode: Callable[[pa.RecordBatch], bytes], head: Callable[[int], bytes], order: list[str], fail: Callable[[int, int], None] | None = None) -> int:
    """Writes df as one file: head(rows), then encode() of the batches in ascending order of columns, nulls first. Returns the number of rows.

    fail: for tests, is called with (partition, attempt) after a part is written and may raise.
    """
    spark = df.sparkSession
    folder = f"{path}.{uuid.uuid4().hex}.parts"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(folder)
        system.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, rows, size = f"part-{task.partitionId():06d}-{task.taskAttemptId()}", 0, 0
        with system.open_output_stream(f"{root}/{name}", compression=None) as sink:
            for batch in batches:
                data = encode(batch)
                sink.write(data)
                rows, size = rows + batch.num_rows, size + len(data)
        if fail:
            fail(task.partitionId(), task.attemptNumber())
        yield pa.RecordBatch.from_pylist([{"part": task.partitionId(), "name": name, "n": rows, "size": size}])

    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    system, root = opened(folder)
    target, final = opened(path)[1], f"{root}/whole"
    try:
        parts = sorted(ordered.mapInArrow(write, "part long, name string, n long, size long").collect())  # a row a task
        rows = sum(r["n"] for r in parts)
        system.create_dir(root, recursive=True)
        with system.open_output_stream(final, compression=None) as sink:
            sink.write(head(rows))
        at, places = len(head(rows)), []
        for r in parts:
            if r["size"]:
                places.append((f"{root}/{r['name']}", at))
            at += r["size"]
        if system.type_name == "local":
            os.truncate(final, at)

            def copy(pieces: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
                for piece in pieces:
                    for name, place in zip(piece["name"], piece["place"]):
                        with open(name, "rb") as source, open(final, "r+b") as sink:
                            sink.seek(place)
                            while data := source.read(CHUNK):
                                sink.write(data)
                    yield piece[["place"]]

            if places:
                spark.createDataFrame(places, "name string, place long").repartition(len(places)).mapInPandas(copy, "place long").count()
        elif places:
            jvm = spark._jvm.org.apache.hadoop.fs
            files = jvm.Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            sources = spark.sparkContext._gateway.new_array(jvm.Path, len(places))
            for k, (name, _) in enumerate(places):
                sources[k] = jvm.Path(f"{folder}/{name.rpartition('/')[2]}")
            files.concat(jvm.Path(f"{folder}/whole"), sources)  # by metadata; a file system that can't raises
        system.move(final, target)
        return rows
    finally:
        if system.get_file_info(root).type.name == "Directory":
            system.delete_dir(root)
