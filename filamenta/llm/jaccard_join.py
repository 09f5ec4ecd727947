"""N-gram Jaccard join as a blocked sparse matrix product (operator 7).

The matrix has a row per distinct shingle set and a column per 5-word shingle.
Documents with equal sets are one row from the start, so a group of copies costs
one row. Columns are dealt into blocks as binary arrays; a block's task counts the
rows of its columns, and what others share of a row comes back to the bucket of
that row, packed into one record a block and bucket.

The product of the matrix with its transpose would emit the square of a common
column's rows, so it is taken over the entries that can begin a link:

* a row enters only the first n - ceil(0.8 n) + 1 of its n columns, rarest first (a
  pair at similarity 0.8 shares one of these); most rows have so many columns of
  their own that they don't enter at all;
* two rows that meet at their places i and j can overlap from there in at most
  min(n_x - i, n_y - j) columns, which must reach 4/9 (n_x + n_y);
* overlap counts of a pair are summed over all columns where it meets, and the pair
  is discarded if the sum and what can follow its last meeting stay below that bound;
* a row misses at least as many columns of another as that has hash residues of
  columns which the first lacks; a sketch of one bit a residue tells.

First counts of shared leading columns elect one partner for each row, twice, and
their full rows are intersected exactly. That joins a group of near copies with as
many products as it has members. Then the product of rows in *different* components
is taken, and the pairs that pass all bounds are intersected. Pairs inside a
component can't change it, so the components are exact and no group emits all its
pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, discard, free_names, giving_back, keep, mix64, quoted, small_batches
from .shingles import WORDS, shingle_sets

#: Shingles that at least 1/512 of the documents of some window of 2**20 shingles hold count as frequent; at most so many are kept, the most frequent.
#: The list only orders columns: results don't depend on it.
FREQUENT, WINDOW = 1 << 18, 1 << 20
#: Rounds in which each row elects a partner; they only save work of the step over all pairs across components.
ELECTIONS = 2
#: Least and most bits of a row's sketch; it has twice as many as the row has columns, as a power of two. A bit stands for the columns of one hash residue.
SKETCH_BITS = (2048, 1 << 17)
#: Bits of the filter that keeps the full rows of uninvolved documents from being shuffled. A full filter lets every row pass; results don't depend on it.
FILTER_BITS = 1 << 23

#: Shingles of a block, so that a task's share of the matrix stays small; distinct sets that a task remembers (a set dealt twice counts once).
BLOCK, SEEN = 2_000_000, 1 << 19

_PROFILE = "doc_id long, mark long, n long, node long, sketch array<long>, shingle long, times long"
_FEASIBLE = "9 * least({a}.n - {a}.i, {b}.n - {b}.i) >= 4 * ({a}.n + {b}.n)"


def _node(shingles: np.ndarray) -> int:
    """The id of a set: a 64-bit digest of its sorted shingles."""
    return int.from_bytes(hashlib.blake2b(shingles.tobytes(), digest_size=8).digest(), "little", signed=True)


def _sketch(shingles: np.ndarray) -> np.ndarray:
    bits = min(SKETCH_BITS[1], max(SKETCH_BITS[0], 1 << (2 * len(shingles) - 1).bit_length())) if len(shingles) else SKETCH_BITS[0]
    flags = np.zeros(bits, bool)
    flags[((shingles >> np.uint64(40)) & np.uint64(bits - 1)).astype(np.intp)] = True
    return np.packbits(flags).view(np.int64)


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's size and id; of each window of WINDOW shingles those that many documents hold."""
    window: list[np.ndarray] = []
    held = 0

    def heavy() -> pa.RecordBatch:
        values, times = np.unique(np.concatenate(window), return_counts=True)
        often = times >= max(4, len(window) // 512)
        nothing = pa.nulls(int(often.sum()), pa.int64())
        return pa.RecordBatch.from_arrays([nothing, nothing, nothing, nothing, pa.nulls(len(nothing), pa.list_(pa.int64())), pa.array(values[often].view(np.int64)), pa.array(times[often].astype(np.int64))], ["doc_id", "mark", "n", "node", "sketch", "shingle", "times"])

    for batch in batches:
        n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        sketches = [np.zeros(0, np.int64)] * batch.num_rows
        for row, s in shingle_sets(batch.column("text")):
            n[row], node[row] = len(s), _node(s)
            sketches[row] = _sketch(s)
            if len(s):
                window.append(s)
                held += len(s)
            if held >= WINDOW:
                yield heavy()
                window, held = [], 0
        nothing = pa.nulls(batch.num_rows, pa.int64())
        sketch = pa.array(sketches, pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("mark"), pa.array(n), pa.array(node), sketch, nothing, nothing], ["doc_id", "mark", "n", "node", "sketch", "shingle", "times"])
    if window:
        yield heavy()


_BLOCKS = "block int, hot boolean, column binary, times binary, length binary, node binary, n binary, d binary"


def _blocks(frequent: tuple[np.ndarray, np.ndarray], blocks: int):
    """Deals the columns of each distinct set of a task into blocks; frequent: sorted shingles and their counts.

    A column is known by the leading 32 + log2(blocks) bits of its shingle's hash, so
    about one in a thousand shares its name with another. That can only add entries
    in common, never hide one. d counts the distinct names of a row.
    """
    known, times = frequent
    bits = 32 + blocks.bit_length() - 1

    def flush(sets: list[np.ndarray], nodes: list[int]) -> Iterator[pa.RecordBatch]:
        n = np.array([len(s) for s in sets], np.int32)
        h = np.concatenate(sets)
        of = np.repeat(np.arange(len(sets)), n)
        node = np.array(nodes, np.int64)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1) if len(known) else np.zeros(len(h), np.intp)
        often = known[at] == h if len(known) else np.zeros(len(h), bool)
        column = h >> np.uint64(64 - bits)
        parts = []
        for hot in (False, True):
            mine = np.flatnonzero(often == hot)
            if len(mine):
                repeats = np.zeros(len(mine), bool)
                repeats[1:] = (column[mine[1:]] == column[mine[:-1]]) & (of[mine[1:]] == of[mine[:-1]])
                parts.append((hot, mine[~repeats]))
        d = sum(np.bincount(of[mine], minlength=len(sets)) for _, mine in parts).astype(np.int32)
        out: list[list] = [[] for _ in range(8)]
        for hot, mine in parts:
            name, row = column[mine], of[mine]
            # a frequent column's entries go to any block, which only passes them on
            block = mix64(node.view(np.uint64)[row] ^ name) % np.uint64(blocks) if hot else name % np.uint64(blocks)
            order = np.argsort(block.astype(np.uint16 if blocks < 1 << 16 else np.int64), kind="stable")
            block, name, row, mine = block[order], name[order], row[order], mine[order]
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            for a, b in zip(cuts, [*cuts[1:], len(order)]):
                rows, lengths = np.unique(row[a:b], return_counts=True)
                stored = name[a:b] if hot else (name[a:b] // np.uint64(blocks)).astype(np.uint32)
                values = (int(block[a]), hot, stored.tobytes(), (np.minimum(times[at[mine[a:b]]], _OFTEN - 1) + _OFTEN).astype(np.int32).tobytes() if hot else b"", lengths.astype(np.uint32).tobytes(), node[rows].tobytes(), n[rows].tobytes(), d[rows].tobytes())
                for held, x in zip(out, values):
                    held.append(x)
        kinds = [pa.int32(), pa.bool_(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], ["block", "hot", "column", "times", "length", "node", "n", "d"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        sets, nodes, held = [], [], 0
        for batch in batches:
            for _, s in shingle_sets(batch.column("text")):
                if not len(s) or (node := _node(s)) in seen:
                    continue
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(node)
                sets.append(s)
                nodes.append(node)
                held += len(s)
                if held >= 1 << 19:
                    yield from flush(sets, nodes)
                    sets, nodes, held = [], [], 0
        if sets:
            yield from flush(sets, nodes)

    return deal


_PACKED = "bucket int, node binary, n binary, d binary, length binary, h binary, times binary"
#: Added to the count of a frequent column, so that these come after all others; counts are cut off below it, which only orders columns.
_OFTEN = 1 << 30


def _shared(blocks: int):
    """Of the blocks of a task, each row's columns that other rows hold too, with the number of rows that hold them.

    Everything that goes to one bucket of rows is one record, so records are as many
    as pairs of tasks and buckets, whatever the rows.
    """

    def packed(node: np.ndarray, n: np.ndarray, d: np.ndarray, h: np.ndarray, times: np.ndarray) -> Iterator[tuple]:
        bucket = (node.view(np.uint64) % np.uint64(blocks)).astype(np.int64)
        order = np.lexsort((node, bucket))
        node, n, d, h, times, bucket = node[order], n[order], d[order], h[order], times[order], bucket[order]
        cuts = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
        for a, b in zip(cuts, [*cuts[1:], len(bucket)]):
            begins = a + np.flatnonzero(np.concatenate([[True], node[a + 1 : b] != node[a : b - 1]]))
            length = np.diff(np.append(begins, b)).astype(np.uint32)
            yield int(bucket[a]), node[begins].tobytes(), n[begins].tobytes(), d[begins].tobytes(), length.tobytes(), h[a:b].tobytes(), times[a:b].tobytes()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bool, list[tuple[np.ndarray, ...]]] = {False: [], True: []}
        rows: list[tuple[np.ndarray, ...]] = []
        base = 0
        for batch in batches:
            for k in range(batch.num_rows):
                block, hot, column, times, length, node, n, d = (c[k].as_py() for c in batch.columns)
                name = np.frombuffer(column, np.uint64) if hot else np.frombuffer(column, np.uint32).astype(np.uint64) * np.uint64(blocks) + np.uint64(block)
                rows.append((np.frombuffer(node, np.int64), np.frombuffer(n, np.int32), np.frombuffer(d, np.int32)))
                row = np.repeat(np.arange(base, base + len(rows[-1][0]), dtype=np.uint32), np.frombuffer(length, np.uint32))
                base += len(rows[-1][0])
                held[hot].append((name, row, np.frombuffer(times, np.int32)))
        if not rows:
            return
        nodes, sizes, names = (np.concatenate(x) for x in zip(*rows))
        rows.clear()
        for hot in (False, True):
            parts = held.pop(hot)
            if not parts:
                continue
            h, row, times = (np.concatenate([p[k] for p in parts]) for k in range(3))
            parts.clear()
            if not hot:  # most columns are in one entry only; these go before anything else is gathered
                order = np.argsort(h)
                same = h[order]
                same = same[1:] == same[:-1]
                often = np.zeros(len(h), bool)
                often[1:] = same
                often[:-1] |= same
                order = order[often]
                h, row = h[order], row[order]
                del order, same, often
            order = np.lexsort((nodes[row], h))
            h, row = h[order], row[order]
            node = nodes[row]
            fresh = np.ones(len(h), bool)  # a set that several tasks saw came several times
            fresh[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
            if hot:
                times = times[order][fresh]
            h, row = h[fresh], row[fresh]
            if not hot:
                begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.intp)
                met = np.minimum(np.diff(np.append(begins, len(h))), _OFTEN - 1)
                times = np.repeat(met, np.diff(np.append(begins, len(h)))).astype(np.int32)
                often = times > 1
                h, row, times = h[often], row[often], times[often]
            del order, fresh, node
            for record in packed(nodes[row], sizes[row], names[row], h, times) if len(h) else ():
                yield pa.RecordBatch.from_arrays([pa.array([record[0]], pa.int32()), *[pa.array([x], pa.binary()) for x in record[1:]]], ["bucket", "node", "n", "d", "length", "h", "times"])

    return count


_ENTRY = "h long, node long, n int, i int"


def _leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, node, n, i): of each row of a task's buckets the columns among its first n - ceil(0.8 n) + 1 that other rows hold, and their places.

    Columns that no other row holds come first, then those with few rows, frequent
    ones last. A row with enough columns of its own has no entries at all. A node is
    one distinct set, whatever the number of its copies.
    """
    parts = []
    for batch in batches:
        for k in range(batch.num_rows):
            node, n, d, length, h, times = (np.frombuffer(batch.column(c)[k].as_py(), kind) for c, kind in (("node", np.int64), ("n", np.int32), ("d", np.int32), ("length", np.uint32), ("h", np.uint64), ("times", np.int32)))
            parts.append((np.repeat(node, length), np.repeat(n, length), np.repeat(d, length), h, times))
    if not parts:
        return
    node, n, d, h, times = (np.concatenate([p[k] for p in parts]) for k in range(5))
    parts.clear()
    order = np.lexsort((h, times, node))
    node, n, d, h = node[order], n[order], d[order], h[order]
    del order, times
    begins = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    size = np.diff(np.append(begins, len(node)))
    own = d - np.repeat(size, size)
    place = own + np.arange(len(node)) - np.repeat(begins, size)
    led = np.flatnonzero(place < n - (4 * n.astype(np.int64) + 4) // 5 + 1)
    for a in range(0, len(led), 1 << 16):
        some = led[a : a + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.array(h[some].view(np.int64)), pa.array(node[some]), pa.array(n[some]), pa.array(place[some].astype(np.int32))], ["h", "node", "n", "i"])


def _rows_of(bits: np.ndarray, words: int):
    """The full rows, one a distinct set and task, of documents whose id may be among those that the filter holds."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            at = np.mod(batch.column("doc_id").to_numpy(zero_copy_only=False), FILTER_BITS)
            chosen = np.flatnonzero((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1)
            if len(chosen):
                fresh = {}
                for _, s in shingle_sets(batch.column("text").take(pa.array(chosen)), words):
                    node = _node(s)
                    if node not in seen:
                        fresh[node] = s.view(np.int64)
                if len(seen) >= SEEN:
                    seen.clear()
                seen.update(fresh)
                yield pa.RecordBatch.from_arrays([pa.array(list(fresh), pa.int64()), pa.array(list(fresh.values()), pa.list_(pa.int64()))], ["node", "shingles"])

    return emit


def full_rows(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the wanted nodes, from the documents whose ids a bounded filter holds."""
    wanted = keep(wanted.join(nodes, "node").select("node", F.coalesce("doc_id", F.lit(-1)).alias("doc_id")), "wanted")
    place = F.pmod("doc_id", F.lit(FILTER_BITS)) + 1
    bitmaps = wanted.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")).collect()  # at most 256 rows of 4 KB
    bits = np.zeros(FILTER_BITS // 8 + 8192, np.uint8)
    for r in bitmaps:
        first = (r["bucket"] - 1) * 4096
        bits[first : first + 4096] |= np.frombuffer(bytes(r["bits"]), np.uint8)
    rows = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").mapInArrow(giving_back(_rows_of(bits, words)), "node long, shingles array<long>")
    rows = keep(rows.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("shingles").alias("shingles")), "rows")
    discard(wanted)
    return rows


def confirmed(docs: DataFrame, nodes: DataFrame, pairs: DataFrame, words: int, share: tuple[int, int]) -> DataFrame:
    """Those of pairs (a, b) of sets, a written table, whose full rows overlap in at least share[0] / share[1] of the sum of their sizes."""
    rows = full_rows(docs, nodes, pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), words)
    # Both joins read tables, so Spark splits the partition of a row that many pairs have in common.
    left = pairs.join(rows.select(F.col("node").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = left.join(rows.select(F.col("node").alias("b"), F.col("shingles").alias("of_b")), "b")
    overlap = F.size(F.array_intersect("of_a", "of_b"))
    links = keep(both.select("a", "b", overlap.alias("o"), (F.size("of_a") + F.size("of_b")).alias("m")).where(F.col("o") * share[1] >= F.col("m") * share[0]).select("a", "b"), "links")
    discard(rows)
    return links


def _verified(docs: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs (a, b) of sets whose exact similarity is 0.8 or more, by their full rows."""
    def folded(x: str, y: str) -> Column:
        """x's sketch with as many bits as y's, if it has twice as many (beyond that, sizes alone tell)."""
        own, half = F.col(f"{x}.sketch"), (F.size(f"{x}.sketch") / 2).cast("int")
        return F.when(half >= F.size(f"{y}.sketch"), F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda p, q: p.bitwiseOR(q))).otherwise(own)

    def missing(x: str, y: str) -> Column:
        alone = F.zip_with(folded(x, y), folded(y, x), lambda p, q: F.coalesce(F.bit_count(p.bitwiseAND(F.bitwise_not(q))), F.lit(0)))
        return F.aggregate(alone, F.lit(0), lambda total, k: total + k)

    a, b = nodes.alias("m"), nodes.alias("w")
    sized = pairs.join(a, F.col("a") == F.col("m.node")).join(b, F.col("b") == F.col("w.node"))
    most = F.least(F.col("m.n") - missing("m", "w"), F.col("w.n") - missing("w", "m"))
    pairs = keep(sized.where(9 * most >= 4 * (F.col("m.n") + F.col("w.n"))).select("a", "b"), "pairs")
    links = confirmed(docs, nodes, pairs, WORDS, (4, 9))
    discard(pairs)
    return links


def _labelled(entries: DataFrame, label: DataFrame | None) -> DataFrame:
    """entries with the component c of each row, its own node at first."""
    if label is None:
        return entries.withColumn("c", F.col("node"))
    return entries.join(label, "node", "left").select("h", "node", "n", "i", F.coalesce("component", "node").alias("c"))


def _elected(labelled: DataFrame) -> DataFrame:
    """(a, b): for each row the partner of another component that most of its columns elect, if their bounds allow.

    A column elects its row of furthest reach, and for the rows in the component of that one the next of another component.
    """
    reach = F.struct(((F.col("n") - F.col("i")) / F.col("n")).alias("part"), "n", "node", "i", "c")
    per = labelled.groupBy("h", "c").agg(F.max(reach).alias("p"))
    first = per.groupBy("h").agg(F.max("p").alias("f"))
    both = per.join(first, "h").groupBy("h").agg(F.first("f").alias("f"), F.max(F.when(F.col("c") != F.col("f.c"), F.col("p"))).alias("s")).where("s is not null")
    chosen = labelled.join(both, "h").withColumn("e", F.when(F.col("c") != F.col("f.c"), F.col("f")).otherwise(F.col("s")))
    votes = chosen.where("9 * least(n - i, e.n - e.i) >= 4 * (n + e.n)").groupBy(F.col("node").alias("a"), F.col("e.node").alias("b")).agg(F.count("*").alias("overlap"))
    return votes.groupBy("a").agg(F.max(F.struct("overlap", "b")).alias("v")).select("a", "v.b")


def _mark() -> Column:
    """Tells rows with one doc_id apart by their texts."""
    return F.xxhash64("text")


def _linked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, mark, n, node) of every row of docs, and (node, doc_id, c) of every distinct set that isn't empty: its smallest doc_id and its component, known by a node."""
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = keep(docs.select("doc_id", "text", _mark().alias("mark")).mapInArrow(giving_back(_profile), _PROFILE), "profile")
    sets = profile.where("n is not null").select("doc_id", "mark", "n", "node")
    often = profile.where("times is not null").groupBy("shingle").agg(F.sum("times").alias("times"))
    rows = often.orderBy(F.desc("times"), "shingle").limit(FREQUENT).toPandas()
    known = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(known)
    frequent = (known[order], rows["times"].to_numpy(np.int64)[order])
    total = sets.agg(F.sum("n")).first()[0] or 0
    blocks = max(spark.sparkContext.defaultParallelism, total // BLOCK + 1)
    dealt = docs.mapInArrow(giving_back(_blocks(frequent, blocks)), _BLOCKS).repartitionById(blocks, F.col("block"))
    shared = dealt.mapInArrow(giving_back(_shared(blocks)), _PACKED).repartitionById(blocks, F.col("bucket"))
    entries = keep(shared.mapInArrow(giving_back(_leading), _ENTRY), "entries")
    nodes = keep(profile.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch")), "nodes")

    links, label = None, None
    for _ in range(ELECTIONS):
        labelled = _labelled(entries, label)
        found = _verified(docs, nodes, _elected(labelled))
        links = found if links is None else links.union(found)
        label = components(links)

    labelled = _labelled(entries, label)
    per = labelled.groupBy("h", "c").agg(F.count("*").alias("times"))
    mixed = per.groupBy("h").agg(F.max(F.struct("times", "c")).alias("most"), F.count("*").alias("components")).where("components > 1").select("h", F.col("most.c").alias("major"))
    open_ = keep(labelled.join(mixed, "h"), "open")
    other = (F.col("x.h") == F.col("y.h")) & (F.col("x.c") != F.col("y.c")) & ((F.col("y.c") == F.col("y.major")) | (F.col("x.node") < F.col("y.node")))
    crossing = open_.where("c <> major").alias("x").join(open_.alias("y"), other & F.expr(_FEASIBLE.format(a="x", b="y")))
    low, high = (lambda c: F.when(F.col("x.node") < F.col("y.node"), F.col(f"x.{c}")).otherwise(F.col(f"y.{c}"))), (lambda c: F.when(F.col("x.node") < F.col("y.node"), F.col(f"y.{c}")).otherwise(F.col(f"x.{c}")))
    met = crossing.select(low("node").alias("a"), high("node").alias("b"), low("n").alias("na"), high("n").alias("nb"), low("i").alias("ia"), high("i").alias("ib"))
    product = met.groupBy("a", "b").agg(F.count("*").alias("o"), F.first("na").alias("na"), F.first("nb").alias("nb"), F.max("ia").alias("ia"), F.max("ib").alias("ib"))
    pairs = product.where("9 * (o + least(na - ia, nb - ib) - 1) >= 4 * (na + nb)").select("a", "b")
    label = components(links.union(_verified(docs, nodes, pairs)))
    discard(entries, open_)

    named = nodes.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("c"))
    return sets, named


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text; further columns are ignored).

    Documents link when 100 * overlap >= 80 * union of their 5-word shingle sets;
    component_id is the smallest doc_id that links reach. Null and empty texts, and
    texts of white space only, have no shingles and link with nothing: their
    component_id is their own doc_id. Repeated rows come back as often as they
    came, in one component. A null doc_id stays null unless linked. An empty table
    gives an empty result.
    """
    sets, named = _linked(docs)
    lowest = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    named = named.join(lowest, "c").select("node", "component_id")
    full = sets.where("n > 0").join(named, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(bare)


def first_of_components(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay when each component of jaccard_components keeps one: that with the smallest doc_id (null last), then the smallest hash of its text.

    Rows are told apart by doc_id and text, so a doc_id that is null or repeated with
    other texts loses nothing but near copies. Rows without shingles all stay.
    """
    sets, named = _linked(docs)
    names = free_names(docs, "id", "none", "mark")
    keys = lambda df, text: [c.alias(n) for c, n in zip((F.coalesce(df["doc_id"].cast("long"), F.lit(0)), df["doc_id"].isNull(), text), names)]
    lowest = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark")).alias("b")
    first = sets.where("n > 0").groupBy("node").agg(lowest).join(named.select("node", "c"), "node").groupBy("c").agg(F.min("b").alias("b"))
    first = first.select(F.col("b.doc_id").alias("doc_id"), F.col("b.mark").alias("mark"))
    first = first.select(*keys(first, F.col("mark")))
    bare = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    own = quoted(*docs.columns)
    rows = docs.where(~bare)
    rows = rows.select(*own, *keys(rows, _mark()))
    stay = rows.dropDuplicates(names).join(first, names, "left_semi")  # copies go before the shuffle
    return stay.select(*own).union(docs.where(bare))
