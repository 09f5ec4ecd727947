"""Sequence packing, shortest pack first over the length histogram (operator 8).

Only the histogram (at most max_tokens lengths) reaches the driver. It places the
lengths longest first: copies of a length go to the open packs with the most room,
as many at once as there are such packs, which updates the counts of packing
patterns; where none has room, new packs take as many copies each as they hold.
Patterns are then joined back to the pieces by each piece's rank among
the pieces of its length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import word_bpe
from .common import giving_back, keep, ranked, small_batches, text_or_empty

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def patterns(histogram: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """(count, lengths from longest to shortest) of the packs that hold the whole histogram."""
    open_: dict[int, list[tuple[int, list[int]]]] = {}  # by used tokens
    used_lengths: list[int] = []
    full: list[tuple[int, list[int]]] = []

    def put(used: int, count: int, lengths: list[int]) -> None:
        if used == limit:
            full.append((count, lengths))
            return
        if used not in open_:
            bisect.insort(used_lengths, used)
            open_[used] = []
        open_[used].append((count, lengths))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            shortest = used_lengths[0] if used_lengths else limit
            if shortest + length > limit:
                each = limit // length  # a new pack is the shortest until it is full
                many, rest = divmod(left, each)
                if many:
                    put(length * each, many, [length] * each)
                if rest:
                    put(length * rest, 1, [length] * rest)
                break
            count, lengths = open_[shortest].pop()
            if not open_[shortest]:
                del open_[shortest]
                used_lengths.pop(0)
            placed = min(left, count)
            put(shortest + length, placed, [*lengths, length])
            if count > placed:
                put(shortest, count - placed, lengths)
            left -= placed
    return full + [p for ps in open_.values() for p in ps]


def token_pieces(docs: DataFrame, vocabulary: str, limit: int, end_id: int) -> DataFrame:
    """Each document's ids and its end id, cut every limit ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe.load(vocabulary)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = bpe.encode(text) + end
                n = len(ids) // 4
                for a in range(0, n, limit):
                    piece = ids[4 * a : 4 * (a + limit)]
                    out.append((doc, a, len(piece) // 4, zlib.crc32(piece), n))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (list(zip(*out)) or [()] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("string").alias("text"))
    return docs.mapInArrow(giving_back(cut), _PIECES)


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048, end_id: int = 1) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece of docs (doc_id, text; further columns are ignored).

    Null and empty texts are the end id alone. Repeated rows are packed as often as
    they came. An empty table gives an empty result. Sequences are numbered from 0
    without gaps; inside one, pieces lie without gaps from offset 0.
    """
    pieces = keep(token_pieces(docs, vocabulary, limit, end_id), "pieces")
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}  # at most limit rows
    places: dict[int, tuple[list[int], list[tuple[int, int, list[int]]]]] = {}
    first, taken = 0, dict.fromkeys(histogram, 0)
    for count, lengths in patterns(histogram, limit):
        at, offsets = 0, {}
        for n in lengths:
            offsets.setdefault(n, []).append(at)
            at += n
        for n, where in offsets.items():
            starts, rows = places.setdefault(n, ([], []))
            starts.append(taken[n])
            rows.append((first, len(where), where))
            taken[n] += count * len(where)
        first += count

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ranks = batch.column("length").to_pylist(), batch.column("_rank").to_pylist()
            sequence, offset = [], []
            for n, r in zip(lengths, ranks):
                starts, rows = places[n]
                k = bisect.bisect_right(starts, r) - 1
                base, each, where = rows[k]
                step, slot = divmod(r - starts[k], each)
                sequence.append(base + step)
                offset.append(where[slot])
            kept = batch.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], [*kept.schema.names, "sequence_id", "offset"])

    bucket = F.pmod(F.xxhash64("doc_id", "start"), F.lit(1024))
    return ranked(pieces, "length", bucket, ["doc_id", "start", "ids_crc32"], "_rank").mapInArrow(placed, f"{_PIECES}, sequence_id long, offset long")
