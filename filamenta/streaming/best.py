"""The best results of a job while it runs: the top rows of every key, kept as state of a stream, told whenever they change."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

#: Results of a key that are kept at most.
BEST = 10


def best_so_far(results: DataFrame, key: str, score: str, rid: str, k: int = BEST) -> DataFrame:
    """(key, version, rank, rid, score): the k best results of each key of a stream, whenever they change; ranks from 1, versions of a key from 1.

    The larger score is better, ties go to the smaller rid (a number). A result that
    comes again changes nothing; one that comes with another score keeps its best one.
    The state of a key is its k best results, whatever the order in which they come: a
    late one is told if it is among them. Rows with a null key, score or rid, or a NaN,
    don't count. Update mode; the highest version of a key is its present state.
    """
    kinds = {f.name: f.dataType.simpleString() for f in results.schema.fields}
    used = results.where(F.col(key).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(rid).isNotNull()).select(key, F.col(score).cast("double").alias("score"), F.col(rid).cast("long").alias("rid"))

    def update(own: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        version, rids, scores = state.get if state.exists else (0, [], [])
        best = dict(zip(rids, scores))
        before = dict(best)
        for part in parts:
            part = part.sort_values(["score", "rid"], ascending=[False, True]).drop_duplicates("rid").head(k)
            for r, s in zip(part["rid"].tolist(), part["score"].tolist()):
                if s > best.get(r, float("-inf")) or r not in best:
                    best[r] = s
            best = dict(heapq.nsmallest(k, best.items(), key=lambda x: (-x[1], x[0])))
        if best == before:
            return
        rows = sorted(best.items(), key=lambda x: (-x[1], x[0]))
        state.update((version + 1, [r for r, _ in rows], [s for _, s in rows]))
        yield pd.DataFrame({key: [own[0]] * len(rows), "version": version + 1, "rank": range(1, len(rows) + 1), "rid": [r for r, _ in rows], "score": [s for _, s in rows]})

    out = f"`{key}` {kinds[key]}, version long, rank long, rid long, score double"
    return used.groupBy(key).applyInPandasWithState(update, out, "version long, rids array<long>, scores array<double>", "update", "NoTimeout")


def best_of(results: DataFrame, key: str, score: str, rid: str, k: int = BEST) -> DataFrame:
    """(key, rank, rid, score) of a batch: what best_so_far() has told last when all of it has come."""
    used = results.where(F.col(key).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")) & F.col(rid).isNotNull())
    once = used.groupBy(key, F.col(rid).cast("long").alias("rid")).agg(F.max(F.col(score).cast("double")).alias("score"))
    w = Window.partitionBy(key).orderBy(F.desc("score"), "rid")  # ranks above k go before the shuffle
    return once.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k).select(key, "rank", "rid", "score")
