"""Context-triggered piecewise hashing of whole texts (operator 10).

A rolling hash over seven bytes of UTF-8 ends a chunk wherever it is -1 modulo the
block size; each chunk adds a base-64 character to the signature, the low six bits
of its hash. The block size is 3 * 2**k, the least that expects at most 64 chunks,
halved while the signature has under 32 characters. A fingerprint is
"block:signature:signature at twice the block". Fingerprints compare by edit
distance where block sizes are equal or one is twice the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import mix64, shuffle_partitions, small_batches, text_or_empty

#: Most parts that the table is dealt into, and the relative error of the quantiles between them (one part).
PARTS = 1 << 16
LENGTH = 64
_ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_SPREAD = mix64(np.arange(1, 257, dtype=np.uint64))
_WINDOW = 7
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _signature(ends: np.ndarray, n: int, total: np.ndarray) -> str:
    """The characters of the chunks that end at ends; everything after the last of LENGTH - 1 ends is one chunk."""
    ends = ends[: LENGTH - 1]
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    begins = np.concatenate([[0], ends[:-1]])
    chunks = mix64((total[ends] - total[begins]) + (ends - begins).astype(np.uint64) * _FACTOR)
    return _ALPHABET[(chunks & np.uint64(63)).astype(np.intp)].tobytes().decode()


def fingerprint(text: bytes) -> str:
    """The fingerprint of UTF-8 bytes; that of none is "3::"."""
    n = len(text)
    if not n:
        return "3::"
    spread = _SPREAD[np.frombuffer(text, np.uint8)]
    # A chunk's hash: the sum of its bytes' spread values, each turned by the byte before it, so order counts.
    turned = spread.copy()
    turned[1:] ^= (spread[:-1] << np.uint64(7)) | (spread[:-1] >> np.uint64(57))
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(mix64(turned), out=total[1:])
    rolling = np.zeros(n, np.uint64)
    for k in range(min(_WINDOW, n)):
        rolling[k:] += (spread[: n - k] << np.uint64(k)) ^ (spread[: n - k] >> np.uint64(64 - k) if k else np.uint64(0))
    rolling = (mix64(rolling) >> np.uint64(32)).astype(np.uint32)
    block = 3
    while block * LENGTH < n:
        block *= 2
    hits = np.flatnonzero(rolling % np.uint32(3) == 2)
    values = rolling[hits].astype(np.uint64)

    def ends(size: int) -> np.ndarray:
        return hits[values % np.uint64(size) == size - 1] + 1

    while True:
        own = _signature(ends(block), n, total)
        if len(own) >= LENGTH // 2 or block == 3:
            return f"{block}:{own}:{_signature(ends(2 * block), n, total)}"
        block //= 2


def edit_distance(a: str, b: str) -> int:
    """Least number of inserted, deleted and replaced characters, by bit-parallel rows (a: at most 64 characters)."""
    if not a or not b:
        return len(a) + len(b)
    m = len(a)
    full, top = (1 << m) - 1, 1 << (m - 1)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    up, down, score = full, 0, m
    for c in b:
        eq = places.get(c, 0)
        x = eq | down
        d = (((x & up) + up) ^ up) | x
        right, left = down | ~(d | up) & full, up & d
        if right & top:
            score += 1
        elif left & top:
            score -= 1
        right = (right << 1 | 1) & full
        left = left << 1 & full
        up, down = left | ~(d | right) & full, right & d
    return score


def likeness(a: str, b: str) -> float:
    """0 to 1: 1 less the edit distance over the longer signature, at the best compatible block size; 0 if none is compatible."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = ((int(p[0]), p[1], p[2]) for p in (f.split(":") for f in (a, b)))
    pairs = [(x1, y1), (x2, y2)] if x == y else [(x1, y2)] if x == 2 * y else [(x2, y1)] if y == 2 * x else []
    best = 0.0
    for p, q in pairs:
        longer = max(len(p), len(q))
        if longer and min(len(p), len(q)):
            if longer <= 2 * min(len(p), len(q)) + 8:
                best = max(best, 1 - edit_distance(p, q) / longer)
    return best


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_NAMES = [c.split()[0] for c in _RESULT.split(", ")]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _row(doc: int | None, text: str, own: str, after: str, its: str) -> tuple:
    third = len(text) // 3
    edited = (text[: len(text) - third] + after[:third]).encode()
    changed = fingerprint(edited)
    return doc, len(text), hashlib.sha256(edited).hexdigest(), own, changed, likeness(own, changed), likeness(own, its)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [()] * 7, _KINDS)], _NAMES)


def _inner(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows but the last of each part, in the order they come."""
    before = None
    for batch in batches:
        rows = []
        for part, doc, text in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
            own = fingerprint(text.encode())
            if before is not None and before[0] == part:
                rows.append(_row(before[1], before[2], before[3], text, own))
            before = (part, doc, text, own)
        yield _batch(rows)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and the last row of each part."""
    first = last = None

    def both() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([last[0]], pa.int32()), pa.array([last[1]], pa.int64()), pa.array([last[2]]), pa.array([first[2]])], ["part", "doc_id", "text", "head"])

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "text"))):
            if first is not None and first[0] != row[0]:
                yield both()
                first = None
            first, last = first or row, row
    if first is not None:
        yield both()


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _batch([_row(doc, text, fingerprint(text.encode()), after, fingerprint(after.encode())) for doc, text, after in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "after")))])


def piecewise_fingerprints(docs: DataFrame, rows_in_part: int = 2000) -> DataFrame:
    """Fingerprints of every row of docs (doc_id, text; further columns are ignored) and of its edited text.

    Columns as in the query's contract. Documents follow each other by descending
    doc_id, repeated ids by text, a null id last; after the last comes the first, so
    a single document follows itself. Null and empty texts have no characters and
    the fingerprint "3::", of likeness 1 to itself and 0 to others. An empty table
    gives an empty result.

    Rows are dealt once, into parts of neighbouring ids by quantiles of doc_id, one a
    task, which Spark sorts with spilling and a worker reads as a stream. The
    last row of a part meets the first of the next one in an aggregation over all tasks.
    Beyond PARTS * rows_in_part rows parts grow; rows of one doc_id are always in one part.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))).cast("double")
    n = docs.count()
    tasks = shuffle_partitions(docs.sparkSession)
    parts = min(PARTS, max(1, n // rows_in_part, tasks))
    shares = [k / parts for k in range(1, parts)]
    cuts = sorted(set(docs.agg(F.percentile_approx(key, shares, max(10_000, 2 * parts))).first()[0] or [])) if shares and n else []
    keyed = docs.withColumn("_key", key)
    if cuts:
        ordered = Bucketizer(splits=[float("-inf"), *cuts, float("inf")], inputCol="_key", outputCol="_part").transform(keyed)
    else:
        ordered = keyed.withColumn("_part", F.lit(0.0))
    number = (F.lit(len(cuts)) - F.col("_part")).cast("int").alias("part")
    keyed_parts, ordered = ordered.select(number), ordered.select(number, "doc_id", "text")
    ordered = ordered.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", F.desc_nulls_last("doc_id"), "text")
    borders = ordered.mapInArrow(_borders, "part int, doc_id long, text string, head string")
    # The part before each one that has rows, the last one for the first: numbers only, at most PARTS of them.
    there = keyed_parts.distinct()
    places = Window.orderBy("part")
    turns = there.select("part", F.coalesce(F.lag("part").over(places), F.max("part").over(places.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before"))
    # A part's last row and the first row of the next one meet under the number of the part.
    last = F.struct(F.col("part").alias("at"), F.struct("doc_id", "text").alias("last"), F.lit(None).cast("string").alias("after"))
    first = F.struct(F.col("before").alias("at"), F.lit(None).cast("struct<doc_id: bigint, text: string>").alias("last"), F.col("head").alias("after"))
    ends = borders.join(F.broadcast(turns), "part").select(F.explode(F.array(last, first)).alias("e")).select("e.*")
    chained = ends.groupBy("at").agg(F.max("last").alias("last"), F.max("after").alias("after")).select("last.doc_id", "last.text", "after")
    crossing = chained.select("doc_id", "text", "after").repartition(tasks).mapInArrow(_crossing, _RESULT)
    return ordered.mapInArrow(_inner, _RESULT).union(crossing)
