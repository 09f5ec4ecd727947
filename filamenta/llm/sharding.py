"""Sharding by balanced label propagation (operator 2), with DataFrame operations only.

Documents are vertices; documents with a common link key (here: equal texts) are
neighbours. Documents of one key that began in one shard and are in one shard now
have the same neighbours and can't be told apart, so labels move on a table of (key,
first shard, shard, number), and a group of copies of any size is a few rows of it.
In each round linked documents ask to move to the shard where most of their
neighbours are; a key that is larger than a shard has as many such shards as it
needs. Requests from shard a to shard b are granted up to a quota: as much as asks
to move from b to a, and a part of b's spare capacity in proportion to the requests.
Requests of a pair are granted in order of buckets of their gain (neighbours there
less neighbours here) and link key; only counts of (pair, bucket) meet in one place.
Rounds end when nothing moves, or after ROUNDS of them. At last each shard gives rows beyond its quota,
unlinked ones first, to shards that lack rows, so that row counts differ by one at
most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, keep, ranked, text_or_empty

BUCKETS = 1024
#: A shard may hold so much more than its even share of linked rows while labels move.
SPARE = 0.02
#: Most rounds of propagation, and documents up to which those of one key and shard move together or not at all.
ROUNDS, TOGETHER = 12, 16


def propagated(units: DataFrame, shards: int, capacity: float, rounds: int = ROUNDS) -> DataFrame:
    """(key, home, shard, n): where the n documents of each key that began in shard home end; units: (key, home, n)."""
    state = keep(units.select("key", "home", F.col("home").alias("shard"), "n"), "labels")
    for _ in range(rounds):
        held = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # a row a shard
        spare = F.array(*[F.lit(max(0.0, capacity - held.get(s, 0))) for s in range(shards)])
        per = state.groupBy("key", "shard").agg(F.sum("n").alias("m"))
        placed = F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("less"), F.xxhash64("key", "shard").alias("h"), "shard")))  # at most a row a shard
        of_key = per.groupBy("key").agg(F.sum("m").alias("total"), placed.alias("placed"), F.map_from_entries(F.collect_list(F.struct("shard", "m"))).alias("at"))
        seats = F.slice(F.transform("placed", lambda p: p["shard"]), F.lit(1), F.least(F.lit(shards), F.ceil(F.col("total") / capacity)).cast("int"))
        of_key = of_key.select("key", "at", seats.alias("seats"))
        asked = state.join(of_key, "key").where(~F.array_contains("seats", F.col("shard")))
        roomy = F.filter("seats", lambda s: F.get(spare, s) >= 1)
        seats = F.when(F.size(roomy) > 0, roomy).otherwise(F.col("seats"))
        to = F.element_at(seats, (F.pmod(F.xxhash64("key", "shard", "home"), F.size(seats)) + 1).cast("int"))
        asked = asked.withColumn("to", to).withColumn("gain", F.element_at("at", F.col("to")) - F.element_at("at", F.col("shard")) + F.col("n"))
        turn = F.pmod(F.xxhash64("key"), F.lit(BUCKETS)).cast("int")
        requests = keep(asked.select("key", "home", "shard", "to", "n", F.when(F.col("gain") > 3, turn).otherwise(turn + BUCKETS).alias("bucket")), "requests")
        counts = requests.groupBy("shard", "to", "bucket").agg(F.sum("n").alias("n"))
        flow = counts.groupBy("shard", "to").agg(F.sum("n").alias("ask"))
        back = flow.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("ask").alias("back"))
        into = flow.groupBy("to").agg(F.sum("ask").alias("asks"))
        share = F.get(spare, F.col("to")) * F.col("ask") / F.col("asks")
        quota = flow.join(into, "to").join(back, ["shard", "to"], "left").select("shard", "to", (F.coalesce("back", F.lit(0)) + share).alias("quota"))
        before = Window.partitionBy("shard", "to").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        part = counts.withColumn("used", F.coalesce(F.sum("n").over(before), F.lit(0))).join(quota, ["shard", "to"])
        part = part.select("shard", "to", "bucket", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("quota") - F.col("used")) / F.col("n"))).alias("part"))
        granted = requests.join(F.broadcast(part), ["shard", "to", "bucket"])  # at most shards**2 * 2 * BUCKETS rows
        drawn = F.pmod(F.xxhash64("key", "home", "shard"), F.lit(1 << 20)) / F.lit(1 << 20)
        whole = F.when(drawn < F.col("part"), F.col("n")).otherwise(F.lit(0))
        moves = granted.withColumn("moved", F.when(F.col("n") <= TOGETHER, whole).otherwise(F.floor(F.col("n") * F.col("part")))).where("moved > 0")
        moves = keep(moves.select("key", "home", "shard", "to", "moved"), "moves")
        total = moves.agg(F.sum("moved")).first()[0]
        if not total:
            discard(requests, moves)
            break
        changes = moves.select("key", "home", "shard", (-F.col("moved")).alias("n")).unionByName(moves.select("key", "home", F.col("to").alias("shard"), F.col("moved").alias("n")))
        after = keep(state.unionByName(changes).groupBy("key", "home", "shard").agg(F.sum("n").alias("n")).where("n > 0"), "labels")
        discard(state, requests, moves)
        state = after
    return state


def shard_documents(docs: DataFrame, shards: int = 8, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, linked) of every row of docs (doc_id, text; further columns are ignored).

    law is "rows": counts of shards differ by one at most. size is the UTF-8 bytes of
    the text (null: none) plus 1; a null text counts as empty for its checksum and
    links with nothing. Empty texts link with each other. slot numbers the rows of a
    shard from 0 without gaps; grown_shard is null. linked tells whether another row
    has the same text. A group larger than a shard takes as few shards as hold it.
    Repeated rows are sharded as often as they came; an empty table gives an empty
    result.
    """
    text = text_or_empty()
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.when(F.col("text").isNotNull(), F.md5(text.cast("binary"))).alias("key"),
    )
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "key", F.lit(7))).withColumn("home", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(shards)).cast("int"))
    rows = keep(rows, "rows")
    total = rows.count()
    units = keep(rows.where("key is not null").groupBy("key", "home").agg(F.count("*").alias("n")), "units")
    groups = units.groupBy("key").agg(F.sum("n").alias("_n")).where("_n > 1").select("key")
    units = units.join(groups, "key")
    linked = units.agg(F.sum("n")).first()[0] or 0
    ends = propagated(units, shards, max(total / shards, linked / shards * (1 + SPARE), 1.0), rounds)
    # One row a key and first shard: where its documents go, by cumulative shares. Documents take theirs by a hash.
    upto = F.sum("n").over(Window.partitionBy("key", "home").orderBy("shard")) / F.sum("n").over(Window.partitionBy("key", "home"))
    plan = ends.withColumn("upto", upto).groupBy("key", "home").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("ends"))
    plan = keep(plan, "plan")
    drawn = F.pmod(F.xxhash64("tie"), F.lit(1 << 20)) / F.lit(1 << 20)
    end = F.get(F.filter("ends", lambda e: e["upto"] > F.col("drawn")), F.lit(0))["shard"]
    keyed = rows.where("key is not null").join(plan, ["key", "home"], "left").withColumn("drawn", drawn)
    keyed = keyed.select("doc_id", "size", "text_crc32", "tie", F.coalesce(end, "home").alias("shard"), F.col("ends").isNotNull().alias("linked"))
    bare = rows.where("key is null").select("doc_id", "size", "text_crc32", "tie", F.col("home").alias("shard"), F.lit(False).alias("linked"))
    labelled = keep(keyed.unionByName(bare), "labelled")

    # Linked rows take the lower buckets, so rows that a shard has to give away are unlinked ones as far as these go.
    half = BUCKETS // 2
    bucket = F.pmod(F.col("tie"), F.lit(half)) + F.when(F.col("linked"), 0).otherwise(half)
    placed = keep(ranked(labelled, "shard", bucket, ["tie", "doc_id"], "rank", BUCKETS), "placed")
    held = {r["shard"]: r["n"] for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}  # a row a shard
    fullest = sorted(range(shards), key=lambda s: (-held.get(s, 0), s))
    quota = {s: total // shards + (k < total % shards) for k, s in enumerate(fullest)}
    over, gaps, given, filled = {}, [], 0, 0
    for s in range(shards):
        extra = held.get(s, 0) - quota[s]
        if extra > 0:
            over[s] = given
            given += extra
        elif extra < 0:
            gaps.append((filled, s, held.get(s, 0)))
            filled -= extra
    number = F.lit(None).cast("long")
    for s, first in over.items():
        number = F.when((F.col("shard") == s) & (F.col("rank") >= quota[s]), F.col("rank") - quota[s] + first).otherwise(number)
    placed = placed.withColumn("_gift", number)
    shard, slot = F.col("shard"), F.col("rank")
    for first, s, has in gaps:
        shard = F.when(F.col("_gift") >= first, F.lit(s)).otherwise(shard)
        slot = F.when(F.col("_gift") >= first, F.col("_gift") - first + has).otherwise(slot)
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "linked")
