"""STAR files as a Spark data source that splits a file by byte ranges.

spark.dataSource.register(StarSource), then spark.read.format("star").load(path):
each range of a block is a partition, so one file of any size is read by as many
tasks as it fills. A range begins after the first line end that it meets and goes on
to the end of the line that crosses its own end. Options:

* block: the block to read, by default the first of BLOCKS that the file has;
* columns: names, separated by commas, of the columns to parse;
* split: bytes of a range;
* index: where blocks begin, as star_index() finds them by tasks; without it, the
  planner looks through the file itself.

Columns are strings unless the reader is given a schema. Comparisons of one column
with values are made before rows leave the source, if the session's
spark.sql.python.filterPushdown.enabled is true. Files must be on a file system that
pyarrow opens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

#: Blocks in the order in which one is chosen.
BLOCKS = ("movies", "micrographs", "particles", "coordinate_files", "images")
#: Bytes of a range, and of what is read at once; rows of a batch.
SPLIT, CHUNK, ROWS = 64 << 20, 1 << 20, 10_000
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: The columns that tell where a row stands: its file, the first byte of its range, its place in the range.
PLACE = ("file", "part", "row")

_TOKEN = re.compile(r"'[^']*'|\"[^\"]*\"|[^\s#]\S*")
_BLOCK = re.compile(rb"(?:^|\n)[ \t]*data_([^\s]*)")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path in it) of a URI or a local path."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


def files_of(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, the files of a folder, or those that a name with * and ? matches, by name."""
    system, root = opened(path)
    prefix = path[: len(path) - len(root)]
    info = system.get_file_info(root)
    if info.type == pafs.FileType.NotFound and re.search("[*?]", root):
        folder = root[: re.search("[*?]", root).start()].rpartition("/")[0] or "/"
        wanted = re.compile("".join("[^/]*" if c == "*" else "[^/]" if c == "?" else re.escape(c) for c in root))
        found = [f for f in system.get_file_info(pafs.FileSelector(folder, recursive=True, allow_not_found=True)) if wanted.fullmatch(f.path)]
    elif info.type == pafs.FileType.Directory:
        found = [f for f in system.get_file_info(pafs.FileSelector(root, recursive=True)) if not re.search(r"(^|/)[._]", f.path[len(root) :].lstrip("/"))]
    else:
        found = [info]
    found = sorted((f for f in found if f.type == pafs.FileType.File), key=lambda f: f.path)
    if not found:
        raise FileNotFoundError(path)
    return [(prefix + f.path, f.size) for f in found]


def markers(path: str, start: int, end: int) -> list[tuple[int, str]]:
    """(place of its line, name) of the blocks whose line begins in a range of bytes."""
    system, root = opened(path)
    out, at, tail = [], max(0, start - 1), b""
    with system.open_input_file(root) as source:
        source.seek(at)
        while at - len(tail) < end:
            data = source.read(CHUNK)
            text = tail + data
            base = at - len(tail)
            # a name may go on behind the chunk, so what follows the last line end waits
            whole = len(text) if not data else text.rfind(b"\n")
            for m in _BLOCK.finditer(text, 0, max(whole, 0)):
                place = base + m.start() + (m[0][:1] == b"\n")
                if start <= place < end:
                    out.append((place, m[1].decode()))
            if not data:
                break
            at += len(data)
            tail = text[max(whole, 0) :]
    return out


def star_index(spark: SparkSession, path: str, split: int = SPLIT) -> str:
    """Where the blocks of STAR files begin, found by a task a range, for the option index."""
    ranges = [(f, a, min(a + split, size)) for f, size in files_of(path) for a in range(0, max(size, 1), split)]

    def look(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame([(f, at, name) for f, a, b in zip(part["file"], part["a"], part["b"]) for at, name in markers(f, a, b)], columns=["file", "at", "name"])

    frame = spark.createDataFrame(ranges, "file string, a long, b long").repartition(min(len(ranges), 10_000))
    found: dict[str, list] = {f: [] for f, _ in files_of(path)}
    for r in frame.mapInPandas(look, "file string, at long, name string").orderBy("file", "at").collect():  # a row a block
        found[r["file"]].append([r["at"], r["name"]])
    return json.dumps(found)


def head_of(path: str, at: int) -> tuple[list[str], int]:
    """(columns, place of the first byte behind the head) of the loop of a block that begins at a place; no columns if the block is no loop."""
    system, root = opened(path)
    columns: list[str] = []
    with system.open_input_file(root) as source:
        source.seek(at)
        rest, looped, first = b"", False, True
        while True:
            data = source.read(CHUNK)
            rest += data
            while b"\n" in rest or not data and rest:
                raw, _, after = rest.partition(b"\n")
                line = raw.strip()
                if looped and columns and line and not line.startswith((b"_", b"#")):
                    return columns, at
                if not first and line.startswith(b"data_"):
                    return (columns if looped else []), at
                looped |= line == b"loop_"
                if looped and line.startswith(b"_"):
                    columns.append(line[1:].split()[0].decode())
                first = False
                at += len(rest) - len(after) if after or b"\n" in rest else len(rest)
                rest = after
            if not data:
                return (columns if looped else []), at


def chosen_block(names: list[str], block: str | None) -> str | None:
    return block if block is not None else next((b for b in BLOCKS if b in names), next(iter(names), None))


class _Range(ds.InputPartition):
    def __init__(self, path: str, start: int, end: int, first: bool, columns: list[str]):
        self.path, self.start, self.end, self.first, self.columns = path, start, end, first, columns


def lines_of(path: str, start: int, end: int, first: bool) -> Iterator[bytes]:
    """The lines that begin in a range of bytes; but for the first range, that after the first line end from start - 1 on."""
    system, root = opened(path)
    at = start if first else start - 1
    with system.open_input_file(root) as source:
        source.seek(at)
        rest, skip = b"", not first
        while True:
            data = source.read(CHUNK)
            pieces = (rest + data).split(b"\n")
            rest = pieces.pop() if data else b""
            for line in pieces:
                if skip:
                    skip = False
                elif at < end:
                    yield line
                else:
                    return
                at += len(line) + 1
            if not data:
                return


class StarReader(ds.DataSourceReader):
    def __init__(self, schema: StructType, options: dict, found: dict):
        self.schema, self.options, self.found = schema, options, found
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterator[ds.Filter]:
        for f in filters:
            plain = type(f) in (ds.EqualTo, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual, ds.In) and len(f.attribute) == 1 and f.attribute[0] not in PLACE
            if plain:
                self.filters.append(f)
            yield f  # Spark looks again, as NaN compares otherwise here

    def partitions(self) -> list[_Range]:
        out, split = [], int(self.options.get("split", SPLIT))
        for path, size in files_of(self.options["path"]):
            places = self.found.get(path) if self.found else None
            places = markers(path, 0, size) if places is None else [tuple(p) for p in places]
            name = chosen_block([n for _, n in places], self.options.get("block"))
            k = next((k for k, (_, n) in enumerate(places) if n == name), None)
            if k is None:
                raise ValueError(f"no block {name} in {path}")
            end = places[k + 1][0] if k + 1 < len(places) else size
            columns, start = head_of(path, places[k][0])
            out += [_Range(path, a, min(a + split, end), a == start, columns) for a in range(start, end, split)]
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no file has a row
            return
        names = [f.name for f in self.schema.fields]
        place = {c: k for k, c in enumerate(partition.columns)}
        kinds = to_arrow_schema(self.schema)
        tests = [(f.attribute[0], f) for f in self.filters]

        def batch(rows: list[list[str]], first: int) -> pa.RecordBatch:
            columns = {}
            for name in names:
                kind = kinds.field(name).type
                if name == "file":
                    columns[name] = pa.array([partition.path] * len(rows), kind)
                elif name == "part":
                    columns[name] = pa.array([partition.start] * len(rows), kind)
                elif name == "row":
                    columns[name] = pa.array(range(first, first + len(rows)), kind)
                else:
                    k = place.get(name)
                    text = [None if k is None or k >= len(r) else r[k] for r in rows]
                    columns[name] = pa.array(text, kind) if pa.types.is_string(kind) else pa.array([_number(t, kind) for t in text], kind)
            out = pa.RecordBatch.from_arrays(list(columns.values()), names)
            for name, f in tests:
                out = out.filter(pa.array(_passes(out.column(name).to_pylist(), f)))
            return out

        rows, first = [], 0
        for line in lines_of(partition.path, partition.start, partition.end, partition.first):
            text = line.decode("utf-8", "replace").strip()
            if not text or text[0] == "#" or text == "loop_":
                continue
            rows.append([t.strip("'\"") for t in _TOKEN.findall(text)] if "'" in text or '"' in text or "#" in text else text.split())
            if len(rows) == ROWS:
                yield batch(rows, first)
                rows, first = [], first + ROWS
        if rows:
            yield batch(rows, first)


def _number(text: str | None, kind: pa.DataType):
    try:
        return None if text is None else int(float(text)) if pa.types.is_integer(kind) else float(text)
    except (ValueError, OverflowError):
        return None


def _passes(values: list, f: ds.Filter) -> list[bool]:
    """Which values a filter lets pass; NaN is left to Spark."""
    if isinstance(f, ds.In):
        wanted = set(f.value)
        return [v in wanted or v != v for v in values]
    test = {ds.EqualTo: lambda v: v == f.value, ds.GreaterThan: lambda v: v > f.value, ds.GreaterThanOrEqual: lambda v: v >= f.value, ds.LessThan: lambda v: v < f.value, ds.LessThanOrEqual: lambda v: v <= f.value}[type(f)]
    return [v is not None and (v != v or f.value != f.value or test(v)) for v in values]


class StarSource(ds.DataSource):
    """spark.read.format("star")."""

    @classmethod
    def name(cls) -> str:
        return "star"

    def _found(self) -> dict:
        return json.loads(self.options["index"]) if "index" in self.options else {}

    def schema(self) -> StructType:
        """PLACE and the columns of the files' blocks, in the order in which they first appear."""
        columns: dict[str, None] = {}
        found = self._found()
        for path, size in files_of(self.options["path"]):
            places = [tuple(p) for p in found[path]] if path in found else markers(path, 0, size)
            name = chosen_block([n for _, n in places], self.options.get("block"))
            at = next((a for a, n in places if n == name), None)
            if at is None:
                raise ValueError(f"no block {name} in {path}")
            columns |= dict.fromkeys(head_of(path, at)[0])
        wanted = self.options.get("columns")
        chosen = list(columns) if wanted is None else [c for c in columns if c in wanted.split(",")]
        own = [StructField("file", StringType()), StructField("part", LongType()), StructField("row", LongType())]
        return StructType(own + [StructField(c, StringType()) for c in chosen if c not in PLACE])

    def reader(self, schema: StructType) -> StarReader:
        return StarReader(schema, dict(self.options), self._found())


def star_frame(spark: SparkSession, path: str, block: str | None = None, columns: list[str] | None = None, schema: str | None = None, split: int = SPLIT, index: str | None = None):
    """The data source's rows of a block, with the index found by tasks."""
    spark.dataSource.register(StarSource)
    spark.conf.set(PUSHDOWN, "true")
    reader = spark.read.format("star").option("split", split).option("index", index or star_index(spark, path, split))
    if block is not None:
        reader = reader.option("block", block)
    if columns is not None:
        reader = reader.option("columns", ",".join(columns))
    return (reader.schema(schema) if schema else reader).load(path)
