"""MinHash near-duplicate groups (operator 13).

Each distinct set of 3-word shingles has the minima of MINIMA universal hashes. BANDS
of them by ROWS give keys: sets that link, at a similarity of 0.85, share none with
probability 1e-8. Equal sets are one node from the start, so a group of copies costs
one node.

In two elections each node takes one partner, the one that most of its keys name, and
so a group of near copies is joined with as many pairs as it has members. What is left
are keys with nodes of several components. There every node outside the key's largest
component is compared with all nodes of other components, by tiles of (key, nodes,
nodes) that are dealt over tasks. A tile discards pairs by sizes, by their signatures,
and by sketches of their sets, which hold 32 bits of every shingle of a short text and
of a sample of a long one. Of the pairs that are left it names a spanning forest, so at
most as many as it has components. Only tiles in which full sets refute a pair are
asked again, for other pairs. No key is capped, and none is expanded into rows of pairs.

Every pair that is left, elected or not, is confirmed on full sets. Components are
those of alternating large and small stars.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, discard, keep, mix64, small_batches
from .jaccard_join import SEEN, _node, confirmed, full_rows
from .shingles import shingle_sets

WORDS, BANDS, ROWS = 3, 25, 4
MINIMA = BANDS * ROWS
#: 100 * overlap >= 85 * union, as a share of the sum of both sizes: overlap / (sizes) >= 17 / 37.
SHARE = (17, 37)
#: Minima in which a pair must agree: a pair at 0.85 agrees in 85 with a deviation of 3.6, so 60 lie seven deviations below.
AGREE = 60
#: Nodes of a side of a tile; elections; most shingles of a sketch.
TILE, ELECTIONS, SKETCHED = 1024, 2, 1024

_rng = np.random.Generator(np.random.PCG64(13))
_FACTORS = _rng.integers(0, 1 << 63, MINIMA, np.uint64) << np.uint64(1) | np.uint64(1)
_ADDENDS = _rng.integers(0, 1 << 63, MINIMA, np.uint64) << np.uint64(1)
_BAND = mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def minima(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash a * x + b (64 bits, of which the upper 32 count) over a set."""
    out = np.full(MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(shingles), 1024):
        np.minimum(out, (_FACTORS[:, None] * shingles[None, a : a + 1024] + _ADDENDS[:, None]).min(1), out)
    return (out >> np.uint64(32)).astype(np.uint32)


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band of a signature."""
    key = _BAND.copy()
    for k in range(ROWS):
        key = mix64(key ^ (signature[k::ROWS].astype(np.uint64) + np.uint64(k << 33)))
    return key


_PROFILE = "doc_id long, n long, node long, signature binary, keys array<long>"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each document its set's size and id, and its signature and keys if the task meets the set for the first time."""
    seen: set[int] = set()
    for batch in batches:
        n, node = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
        signatures: list = [None] * batch.num_rows
        keys: list = [None] * batch.num_rows
        for row, s in shingle_sets(batch.column("text"), WORDS):
            n[row], node[row] = len(s), _node(s)
            if len(s) and int(node[row]) not in seen:
                if len(seen) >= SEEN:
                    seen.clear()
                seen.add(int(node[row]))
                m = minima(s)
                signatures[row], keys[row] = m.tobytes(), band_keys(m).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(node), pa.array(signatures, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n", "node", "signature", "keys"])


def _labelled(entries: DataFrame, label: DataFrame | None) -> DataFrame:
    if label is None:
        return entries.withColumn("c", F.col("node"))
    return entries.join(label, "node", "left").select("h", "node", F.coalesce("component", "node").alias("c"))


def _mixed(labelled: DataFrame) -> DataFrame:
    """(h, most, nodes): keys whose nodes are in several components, with the largest of these (times, c, node) and the number of nodes."""
    per = labelled.groupBy("h", "c").agg(F.count("*").alias("times"), F.min("node").alias("node"))
    out = per.groupBy("h").agg(F.max(F.struct("times", "c", "node")).alias("most"), F.sum("times").alias("nodes"), F.count("*").alias("components"))
    return out.where("components > 1").drop("components")


def _elected(labelled: DataFrame) -> DataFrame:
    """(a, b): for each node the partner in another component that most of its keys name, which is one of the key's largest component."""
    named = labelled.join(_mixed(labelled), "h").where("c <> most.c").groupBy(F.col("node").alias("a"), F.col("most.node").alias("b")).agg(F.count("*").alias("keys"))
    return named.groupBy("a").agg(F.max(F.struct("keys", "b")).alias("v")).select("a", "v.b")


def _agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures agree in at least AGREE minima."""
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, MINIMA) for c in ("of_a", "of_b"))
        chosen = pa.array(np.flatnonzero((x == y).sum(1) >= AGREE))
        yield pa.RecordBatch.from_arrays([batch.column("a").take(chosen), batch.column("b").take(chosen)], ["a", "b"])


def _verified(docs: DataFrame, nodes: DataFrame, signatures: DataFrame, pairs: DataFrame) -> DataFrame:
    """Those of pairs that sizes allow, signatures show and full sets confirm."""
    x, y = nodes.select(F.col("node").alias("a"), F.col("n").alias("na")), nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"))
    sized = keep(pairs.join(x, "a").join(y, "b").where("100 * least(na, nb) >= 85 * greatest(na, nb)").select("a", "b"), "sized")
    wanted = sized.select(F.col("a").alias("node")).union(sized.select("b")).distinct()
    some = keep(signatures.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("signature").alias("signature")), "signatures")
    both = sized.join(some.select(F.col("node").alias("a"), F.col("signature").alias("of_a")), "a").join(some.select(F.col("node").alias("b"), F.col("signature").alias("of_b")), "b")
    pairs = keep(both.mapInArrow(_agree, "a long, b long"), "agreeing")
    links = confirmed(docs, nodes, pairs, WORDS, SHARE)
    discard(sized, some, pairs)
    return links


_SKETCH = "node long, low binary, n long, level int, sampled int, deep int, sampled_deep int, sketch binary"


def sketched(shingles: np.ndarray) -> tuple[int, int, int, int, bytes]:
    """(level, sampled, deep, sampled_deep, sketch): 32 bits of each shingle that ends in `level` zero bits, the least level with at most SKETCHED of them.

    The first `deep` of the distinct values belong to the sampled_deep shingles of the
    next level, so that sets of neighbouring levels can be compared.
    """
    level = 0
    while True:
        mine = shingles[shingles & np.uint64((1 << level) - 1) == 0]
        if len(mine) <= SKETCHED:
            break
        level += 1
    further = mine & np.uint64((2 << level) - 1) == 0
    deep, rest = (np.unique((mine[x] >> np.uint64(32)).astype(np.uint32)) for x in (further, ~further))
    rest = np.setdiff1d(rest, deep, True)
    return level, len(mine), len(deep), int(further.sum()), np.concatenate([deep, rest]).tobytes()


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for node, shingles in zip(batch.column("node").to_pylist(), batch.column("shingles")):
            s = shingles.values.to_numpy().view(np.uint64)
            level, sampled, deep, sampled_deep, sketch = sketched(s)
            rows.append({"node": node, "low": minima(s).astype(np.uint8).tobytes(), "n": len(s), "level": level, "sampled": sampled, "deep": deep, "sampled_deep": sampled_deep, "sketch": sketch})
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("node", pa.int64()), ("low", pa.binary()), ("n", pa.int64()), *[(k, pa.int32()) for k in ("level", "sampled", "deep", "sampled_deep")], ("sketch", pa.binary())]))


class _Side:
    """The nodes of a tile's side as arrays."""

    def __init__(self, rows: pa.Table):
        self.node, self.c, self.n, self.level, self.sampled, self.deep, self.sampled_deep = (rows[k].to_numpy() for k in ("node", "c", "n", "level", "sampled", "deep", "sampled_deep"))
        self.low = np.frombuffer(b"".join(rows["low"].to_pylist()), np.uint8).reshape(len(self.node), MINIMA)
        self.whole = [np.frombuffer(x, np.uint32) for x in rows["sketch"].to_pylist()]
        self.size = np.array([len(v) for v in self.whole])
        self.values = np.full((len(self.whole), max(self.size, default=0)), 1 << 16, np.int32)  # filled up with what no sketch holds
        for k, v in enumerate(self.whole):
            self.values[k, : len(v)] = v & np.uint32(0xFFFF)


def _may_link(a: _Side, k: int, b: _Side, rows: np.ndarray) -> np.ndarray:
    """(row of b, share of the sketches in common) of those rows that may link with row k of a. Only collisions of 16 bits and, from level 1 on, seven deviations of the estimate let more pairs pass than link."""
    out, shared = [], []
    for level in (a.level[k], a.level[k] + 1):  # b's level is a's, one less, or one more
        same = rows[b.level[rows] == level] if level > a.level[k] else rows[(b.level[rows] == level) | (b.level[rows] == level - 1)]
        if not len(same):
            continue
        mark = np.zeros((1 << 16) + 1, bool)
        mine = a.values[k, : a.deep[k] if level > a.level[k] else a.size[k]]
        m_a, slack_a = (a.sampled_deep[k], a.sampled_deep[k] - a.deep[k]) if level > a.level[k] else (a.sampled[k], a.sampled[k] - a.size[k])
        mark[mine] = True
        lower = b.level[same] < level
        used = np.where(lower, b.deep[same], b.size[same])
        hits = mark[b.values[same]] & (np.arange(b.values.shape[1]) < used[:, None])
        m_b = np.where(lower, b.sampled_deep[same], b.sampled[same])
        o = hits.sum(1) + np.minimum(slack_a, m_b - used)
        union = np.maximum(m_a + m_b - o, 1)
        margin = 7 * np.sqrt(0.85 * 0.15 / union) if level else 0.0
        passed = o >= (0.85 - margin - 1e-12) * union
        out.append(same[passed])
        shared.append(o[passed] / union[passed])
    far = rows[np.abs(b.level[rows] - a.level[k]) > 1]  # no common sample: the signatures alone tell
    return np.column_stack([np.concatenate([*out, far]), np.concatenate([*shared, np.zeros(len(far))])])


def _links_by_sketch(a: _Side, k: int, b: _Side, m: int) -> bool:
    """Whether 32 bits of all shingles let row k of a link with row m of b; sketches of samples don't tell."""
    if a.level[k] or b.level[m]:
        return True
    o = len(np.intersect1d(a.whole[k], b.whole[m], True)) + min(a.n[k] - a.size[k], b.n[m] - b.size[m])
    return bool(100 * o >= 85 * (a.n[k] + b.n[m] - o))


def _forest(a: _Side, b: _Side, pairs: np.ndarray, left: np.ndarray) -> list[int]:
    """Positions in pairs (row of a, row of b), best first, of a spanning forest of both sides' components. Of those in left, it takes out what it takes and what sketches refute."""
    names, of = np.unique(np.concatenate([a.c[pairs[:, 0]], b.c[pairs[:, 1]]]), return_inverse=True)
    x, y = of[: len(pairs)], of[len(pairs) :]
    root, out = np.arange(len(names)), []

    def top(k: int) -> int:
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    for at in range(0, len(pairs), 4096):
        while (root[root] != root).any():
            root = root[root]
        some = np.arange(at, min(at + 4096, len(pairs)))
        for p in some[left[some] & (root[x[some]] != root[y[some]])].tolist():
            u, v = top(x[p]), top(y[p])
            if u != v:
                left[p] = False
                if _links_by_sketch(a, pairs[p, 0], b, pairs[p, 1]):
                    root[u] = v
                    out.append(p)
    return out


_TRIED = "h long, i int, j int, a long, b long"


def _tiled(forests: int):
    """(h, i, j, a, b) of tiles, sorted rows (h, i, j, outside, ...): pairs that may link of nodes outside the key's largest component and of any others.

    They are the edges of a spanning forest of the tile's components, or of as many
    forests without common edges as asked for, so that there are no more pairs than
    components in each. A row whose `outside` is null is a refuted pair (node, c),
    which the tile doesn't name again.
    """

    def pairs(tile: pa.Table) -> Iterator[pa.RecordBatch]:
        outside, known = tile["outside"], tile.filter(pc.is_null(tile["outside"]))
        mine, all_ = _Side(tile.filter(outside)), _Side(tile.filter(pc.invert(outside)))
        if not len(mine.node) or not len(all_.node):
            return
        met = []
        for k in range(len(mine.node)):
            sizes = 100 * np.minimum(all_.n, mine.n[k]) >= 85 * np.maximum(all_.n, mine.n[k])
            some = np.flatnonzero(sizes & (all_.c != mine.c[k]))
            some = some[(all_.low[some] == mine.low[k]).sum(1) >= AGREE]
            if len(some):
                some = _may_link(mine, k, all_, some)
                met.append(np.column_stack([np.full(len(some), k), some]))
        met = np.concatenate(met) if met else np.zeros((0, 3))
        if not len(met):
            return
        rows = met[:, :2].astype(np.intp)
        one, two = mine.node[rows[:, 0]], all_.node[rows[:, 1]]
        one, two = np.minimum(one, two), np.maximum(one, two)
        order = np.lexsort((two, one, -met[:, 2]))  # all tiles prefer the same pairs
        rows, one, two = rows[order], one[order], two[order]
        left = np.ones(len(rows), bool)
        if known.num_rows:
            refuted = set(zip(known["node"].to_pylist(), known["c"].to_pylist()))
            left = np.array([p not in refuted for p in zip(one.tolist(), two.tolist())], bool)
        left[1:] &= (one[1:] != one[:-1]) | (two[1:] != two[:-1])  # two nodes outside meet twice
        taken: list[int] = []
        for _ in range(forests):
            new = _forest(mine, all_, rows, left)
            if not new:
                break
            taken += new
        h, i, j = (tile[k][0].as_py() for k in ("h", "i", "j"))
        n = len(taken)
        yield pa.RecordBatch.from_arrays([pa.array([h] * n, pa.int64()), pa.array([i] * n, pa.int32()), pa.array([j] * n, pa.int32()), pa.array(one[taken], pa.int64()), pa.array(two[taken], pa.int64())], ["h", "i", "j", "a", "b"])

    def key(batch: pa.RecordBatch) -> tuple:
        return tuple(batch.column(k)[0].as_py() for k in ("h", "i", "j"))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            h, i, j = (batch.column(k).to_numpy() for k in ("h", "i", "j"))
            cuts = [0, *(np.flatnonzero((h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if held and key(held[0]) != key(part):
                    yield from pairs(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return tiled


def _crossing(docs: DataFrame, nodes: DataFrame, known: DataFrame, labelled: DataFrame) -> DataFrame:
    """Links (a, b) of nodes in different components that share a key, so many that with those known they join all components that have any.

    Each round confirms the pairs that tiles name, at most a forest each. A tile all of
    whose pairs are confirmed is done. The others are asked again, with the components
    and the refuted pairs known by then, for four times as many forests.
    """
    mixed = _mixed(labelled).select("h", F.col("most.c").alias("major"), F.ceil(F.col("nodes") / TILE).cast("int").alias("across"), F.ceil((F.col("nodes") - F.col("most.times")) / TILE).cast("int").alias("down"))
    open_ = keep(labelled.join(mixed, "h").select("h", "node", "c", F.expr("c <> major").alias("outside"), "across", "down"), "open")
    rows = full_rows(docs, nodes, open_.select("node").distinct(), WORDS)
    sketches = keep(rows.mapInArrow(_sketches, _SKETCH), "sketches")
    discard(rows)
    place = lambda n, salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col(n)).cast("int")
    own = ["h", "i", "j", "outside", "node", "c", "low", "n", "level", "sampled", "deep", "sampled_deep", "sketch"]
    part = ["h", "i", "j"]

    def tiles(rows: DataFrame) -> DataFrame:
        down, across = (F.explode(F.sequence(F.lit(0), F.col(n) - 1)) for n in ("down", "across"))
        mine = rows.where("outside").withColumn("i", place("down", 1)).withColumn("j", across)
        all_ = rows.withColumn("outside", F.lit(False)).withColumn("i", down).withColumn("j", place("across", 2))
        return mine.unionByName(all_)

    asked, forests = tiles(open_).join(sketches, "node").select(*own), 1
    links = docs.sparkSession.createDataFrame([], "a long, b long")
    refuted, read = None, [open_, sketches]
    while True:
        tried = keep(asked.repartition(*part).sortWithinPartitions(*part).mapInArrow(_tiled(forests), _TRIED), "tried")
        pairs = keep(tried.select("a", "b").distinct(), "pairs")
        found = confirmed(docs, nodes, pairs, WORDS, SHARE)
        links = links.union(found)
        new = keep(tried.join(found, ["a", "b"], "left_anti").select(*part, "a", "b"), "refuted")
        discard(tried, pairs)
        read.append(new)
        if new.isEmpty():
            break
        again = new.select(*part).distinct()
        refuted = new if refuted is None else keep(refuted.join(again, part, "left_semi").union(new), "refuted")
        label = components(known.union(links))
        read += [refuted, label]
        keys = open_.join(again.select("h").distinct(), "h", "left_semi").join(label, "node", "left").withColumn("c", F.coalesce("component", "c")).drop("component")
        asked = tiles(keys).join(again, part, "left_semi").join(sketches, "node").select(*own)
        pairs_known = refuted.select(*part, F.col("a").alias("node"), F.col("b").alias("c"))
        asked, forests = asked.unionByName(pairs_known, allowMissingColumns=True), 4 * forests
    discard(*read)
    return links


def minhash_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of docs (doc_id, text; further columns are ignored).

    Documents link when 100 * overlap >= 85 * union of their 3-word shingle sets, as
    full sets confirm; component_id is the smallest doc_id that links reach, and kept
    says that it is the row's own. Null and empty texts, and texts of white space
    only, have no shingles and link with nothing. Repeated rows come back as often as
    they came, in one component, and are all kept if their doc_id is its smallest. A
    null doc_id counts as larger than any other: its component_id is null, and it is
    kept, only if no other doc_id is linked. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    profile = keep(docs.mapInArrow(_profile, _PROFILE), "profile")
    sets = profile.select("doc_id", "n", "node")
    nodes = keep(sets.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n")), "nodes")
    signatures = profile.where("signature is not null").select("node", "signature")
    entries = profile.where("signature is not null").select(F.explode("keys").alias("h"), "node").distinct()
    several = entries.groupBy("h").agg(F.count("*").alias("times")).where("times > 1").select("h")
    entries = keep(entries.join(several, "h", "left_semi"), "entries")

    links, label = spark.createDataFrame([], "a long, b long"), None
    for _ in range(ELECTIONS):
        links = links.union(_verified(docs, nodes, signatures, _elected(_labelled(entries, label))))
        label = components(links)
    label = components(links.union(_crossing(docs, nodes, links, _labelled(entries, label))))
    discard(entries)

    named = nodes.select("node", "doc_id").join(label, "node", "left").select("node", "doc_id", F.coalesce("component", "node").alias("c"))
    lowest = named.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    full = sets.where("n > 0").join(named.join(lowest, "c").select("node", "component_id"), "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    bare = sets.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.union(bare).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
