"""Filters, duplicates, top-k, samples and splits. Row order is the column rid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .averages import elbow
from .ranking import kth_smallest, numbered, running_before


def with_variation(df: DataFrame, image: str) -> DataFrame:
    """Rows whose image (an array of numbers) isn't blank."""
    return df.where(F.array_max(image) > F.array_min(image))


def with_any_class(helices: DataFrame, classes: str, chosen: list) -> DataFrame:
    """Helices whose list of classes has one of the chosen ones."""
    return helices.where(F.arrays_overlap(classes, F.array(*[F.lit(c) for c in chosen])))


def is_in(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isin(values))


def between_open(df: DataFrame, column: str, low: float, high: float) -> DataFrame:
    return df.where((F.col(column) > low) & (F.col(column) < high))


def ratio_range(df: DataFrame, column: str, first: float, last: float) -> DataFrame:
    """Rows from the value at share first (inclusive) up to that at share last (exclusive; all of the rest at 1)."""
    n = df.count()
    low = kth_smallest(df, column, max(1, int(n * first)))
    out = df.where(F.col(column) >= F.lit(low))
    return out if last >= 1 else out.where(F.col(column) < F.lit(kth_smallest(df, column, int(n * last) + 1)))


def row_ratio_range(df: DataFrame, rid: str, first: float, last: float) -> DataFrame:
    """Rows numbered (in order of rid) from round(n * first) up to round(n * last), exclusive; halves round to even."""
    n = df.count()
    ranked = numbered(df, [rid], "_place", 0)
    return ranked.where((F.col("_place") >= round(n * first)) & (F.col("_place") < round(n * last))).drop("_place")


def longest(helices: DataFrame, length: str, keys: list[str], share: float = 1.0, most: int = 0, cutoff: float = 0.0) -> DataFrame:
    """Helices by descending length: the first share of them (rounded down), of these the first most (0: all), of these those of at least cutoff."""
    n = helices.count()
    ranked = numbered(helices.withColumn("_less", -F.col(length)), ["_less", *keys], "_place")
    limit = min(int(n * share), most or n)
    return ranked.where((F.col("_place") <= limit) & (F.col(length) >= cutoff)).drop("_less", "_place")


def random_per_bin(df: DataFrame, bins: list[str], k: int, rid: str, seed: int = 1) -> DataFrame:
    """k rows of each bin by a seeded hash."""
    w = Window.partitionBy(*bins).orderBy(drawn(rid, seed), rid)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def elbow_count(df: DataFrame, bins: list[str]) -> int:
    """The count of that bin at which the curve of counts, sorted from high to low, lies farthest from the chord between its ends; of ties the first."""
    counts = numbered(df.groupBy(*bins).agg((-F.count("*")).alias("_less")), ["_less", *bins], "_place", 0).select(F.lit(1).alias("_one"), "_place", (-F.col("_less")).alias("_n"))
    at = elbow(counts, ["_one"], "_place", "_n").join(counts, ["_one", "_place"]).select("_n").first()
    return int(at[0]) if at else 0


def best_first(df: DataFrame, score: str, rid: str, name: str = "rank") -> DataFrame:
    """df with the rank of rows by descending score (null last), ties by rid."""
    return numbered(df.withColumn("_none", F.col(score).isNull()).withColumn("_less", -F.col(score)), ["_none", "_less", rid], name).drop("_none", "_less")


def rows_between(df: DataFrame, rid: str, first: int, last: int) -> DataFrame:
    return df.where((F.col(rid) >= first) & (F.col(rid) < last))


def stride(df: DataFrame, rid: str, sets: int, subset: int) -> DataFrame:
    return df.where(F.col(rid) % sets == subset)


def first_of(df: DataFrame, keys: list[str], rid: str) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(rid)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def min_duplicates(df: DataFrame, key: str, n: int, rid: str) -> DataFrame:
    """The first row of each key that at least n rows have; counts are aggregated before the shuffle."""
    often = df.groupBy(key).agg(F.count("*").alias("_c"), F.min(rid).alias("_r")).where(F.col("_c") >= n)
    return df.join(often, (df[key] == often[key]) & (df[rid] == often["_r"]), "left_semi")


def one_per_group(df: DataFrame, keys: list[str], rid: str) -> DataFrame:
    """For each key the first value that isn't null of every other column, by partial aggregation."""
    values = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col(rid))).alias(c) for c in values])


def best_per_bin(df: DataFrame, bins: list[str], score: str, k: int, rid: str) -> DataFrame:
    w = Window.partitionBy(*bins).orderBy(F.desc_nulls_last(score), rid)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def drawn(rid: str, seed: int = 1) -> Column:
    """A hash of row id and seed as text, which other systems can repeat: the MD5 of "id:seed" in lower-case hex."""
    return F.md5(F.concat(F.col(rid).cast("string"), F.lit(f":{seed}")))


def random_sample(df: DataFrame, group: str, n: int, rid: str, seed: int = 1) -> DataFrame:
    """n rows of each group by a seeded hash of rid."""
    w = Window.partitionBy(group).orderBy(drawn(rid, seed), rid)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def split_random(df: DataFrame, rid: str, sets: int, seed: int = 1) -> DataFrame:
    return df.withColumn("subset", (F.conv(F.substring(drawn(rid, seed), 1, 8), 16, 10).cast("long") % sets + 1).cast("int"))


def split_even_odd(df: DataFrame, rid: str, sets: int = 2) -> DataFrame:
    return df.withColumn("subset", (F.col(rid) % sets + 1).cast("int"))


def dealt(histogram: dict[int, int], sets: int) -> list[tuple[int, int, int, list[int]]]:
    """(size, first, last, subsets): of the groups of each size, those numbered first to last - 1 go to these subsets in turn.

    The groups go largest first to the smallest subset, ties to the first. Groups of one
    size aren't counted out one by one: the smallest subset takes as many at once as
    bring it to the next one, and once subsets differ by less than the size, they take
    turns.
    """
    held, out = [0] * sets, []
    for size in sorted(histogram, reverse=True):
        left, at = histogram[size], 0
        while left:
            order = sorted(range(sets), key=lambda k: (held[k], k))
            if held[order[-1]] - held[order[0]] < size:
                out.append((size, at, at + left, order))
                for place, k in enumerate(order):
                    held[k] += size * (left // sets + (place < left % sets))
                break
            first, next_ = order[0], order[1]
            take = min(left, max(1, -(-(held[next_] - held[first]) // size)))
            out.append((size, at, at + take, [first]))
            held[first] += size * take
            at, left = at + take, left - take
    return out


def split_largest_first(df: DataFrame, keys: list[str], rid: str, sets: int) -> DataFrame:
    """df with subset: whole groups to subsets, largest first into the smallest subset, ties by first appearance.

    The greedy pass runs over the histogram of group sizes; a group finds its subset by
    its number among those of its size.
    """
    groups = df.groupBy(*keys).agg((-F.count("*")).alias("_less"), F.min(rid).alias("_first"))
    sizes = {-r["_less"]: r["n"] for r in groups.groupBy("_less").agg(F.count("*").alias("n")).collect()}  # distinct sizes: at most the root of twice the rows
    larger, before = {}, 0
    for size in sorted(sizes, reverse=True):
        larger[size], before = before, before + sizes[size]
    runs = [(-size, larger[size] + a, larger[size] + b, [k + 1 for k in order]) for size, a, b, order in dealt(sizes, sets)]
    runs = df.sparkSession.createDataFrame(runs, "_less long, _a long, _b long, _order array<int>")
    ranked = running_before(groups, ["_less", "_first"], F.lit(1).cast("long"), "_rank")
    ranked = ranked.join(runs, "_less").where((F.col("_rank") >= F.col("_a")) & (F.col("_rank") < F.col("_b")))
    subset = F.get("_order", ((F.col("_rank") - F.col("_a")) % F.size("_order")).cast("int"))
    return df.join(ranked.select(*keys, subset.alias("subset")), keys)


def _bundles(counts: dict[int, int]) -> list[tuple[int, int]]:
    """(size, number) in powers of two that make up every number of items of a size."""
    out = []
    for size, count in sorted(counts.items()):
        k = 1
        while count:
            out.append((size, min(k, count)))
            count, k = count - out[-1][1], 2 * k
    return out


def _sums(bundles: list[tuple[int, int]], most: int, reached: int = 1) -> int:
    """The sums up to most that items of bundles reach, as bits of a number."""
    inside = (1 << (most + 1)) - 1
    for size, take in bundles:
        reached = (reached | reached << (size * take)) & inside
    return reached


def _items(bundles: list[tuple[int, int]], goal: int, most: int) -> dict[int, int]:
    """How many items of each size make up a sum that is reached. Only every so many-th state is kept; those between are worked out again."""
    step = max(1, int(len(bundles) ** 0.5))
    kept = [1]
    for k in range(0, len(bundles), step):
        kept.append(_sums(bundles[k : k + step], most, kept[-1]))
    out: dict[int, int] = {}
    for block in range(len(kept) - 2, -1, -1):
        part = bundles[block * step : (block + 1) * step]
        states = [kept[block]]
        for b in part[:-1]:
            states.append(_sums([b], most, states[-1]))
        for (size, take), before in zip(reversed(part), reversed(states)):
            if not before >> goal & 1:
                out[size] = out.get(size, 0) + take
                goal -= size * take
    return out


def even_halves(sizes: dict[int, int], windowed: bool | None = None) -> dict[int, int]:
    """Of groups (size: number) how many of each size make one of two halves whose sums differ as little as possible; it is the smaller one.

    From an even deal of every size, with odd ones left dealt so that the halves differ
    by at most the largest size w, moves to either side make it the best one. Moves can
    be put in an order in which their sum stays within w around its way, so 3 w + 1 of
    them are enough (of more, some between two equal sums add up to nothing), and
    each side's sums stay below 2 w squared + w: states depend on the largest group, not
    on the number of rows. Where all rows are fewer, their sums are taken at once.
    """
    total = sum(n * c for n, c in sizes.items())
    if not total:
        return dict.fromkeys(sizes, 0)
    w = max(sizes)
    bound = 2 * w * w + w
    if not (total // 2 > bound if windowed is None else windowed):
        bundles = _bundles(sizes)
        reached = _sums(bundles, total // 2)
        return _items(bundles, reached.bit_length() - 1, total // 2)
    mine = {n: c // 2 for n, c in sizes.items()}
    apart = 0  # the first half less the second
    for n in sorted((n for n, c in sizes.items() if c % 2), reverse=True):
        if apart <= 0:
            mine[n], apart = mine[n] + 1, apart + n
        else:
            apart -= n
    moves = 3 * w + 1
    in_, out_ = (_bundles({n: min(c, moves) for n, c in x.items() if c}) for x in ({n: sizes[n] - mine[n] for n in sizes}, mine))
    gained, lost = _sums(in_, bound), _sums(out_, bound)
    for left in sorted(range(-w, w + 1), key=abs):
        if (left - apart) % 2:
            continue
        move = (left - apart) // 2  # what the first half must gain
        both = gained & (lost << move) if move >= 0 else (gained << -move) & lost
        if both:
            at = (both & -both).bit_length() - 1
            plus, minus = (at, at - move) if move >= 0 else (at + move, at)
            for n, k in _items(in_, plus, bound).items():
                mine[n] += k
            for n, k in _items(out_, minus, bound).items():
                mine[n] -= k
            return mine if left <= 0 else {n: sizes[n] - mine[n] for n in sizes}
    raise AssertionError("the even deal itself is within reach")


def split_in_halves(df: DataFrame, keys: list[str], rid: str) -> DataFrame:
    """df with subset 1 or 2: whole groups (micrographs) to two subsets whose row counts differ as little as possible.

    even_halves() works on the histogram of group sizes, which reaches the driver (distinct
    sizes: at most the root of twice the rows); a group finds its subset by its number
    among those of its size, in order of first appearance.
    """
    groups = df.groupBy(*keys).agg((-F.count("*")).alias("_less"), F.min(rid).alias("_first"))
    sizes = {-r["_less"]: r["n"] for r in groups.groupBy("_less").agg(F.count("*").alias("n")).collect()}
    chosen = even_halves(sizes)
    larger, before = {}, 0
    for size in sorted(sizes, reverse=True):
        larger[size], before = before, before + sizes[size]
    bounds = df.sparkSession.createDataFrame([(-size, larger[size] + chosen.get(size, 0)) for size in sizes], "_less long, _to long")
    ranked = running_before(groups, ["_less", "_first"], F.lit(1).cast("long"), "_rank").join(bounds, "_less")
    return df.join(ranked.select(*keys, F.when(F.col("_rank") < F.col("_to"), 1).otherwise(2).alias("subset")), keys)


def with_opposite(df: DataFrame, angle: str, group: str) -> DataFrame:
    """df and once more with the angle turned by 180 degrees, its groups' numbers raised by the power of ten above the largest (at least 10), so that they stay apart."""
    ten = df.agg(F.pow(F.lit(10.0), F.ceil(F.log10(F.greatest(F.max(group), F.lit(2))))).cast("long").alias("_ten"))
    turned = df.withColumn(angle, F.col(angle) + 180).join(F.broadcast(ten)).withColumn(group, F.col(group) + F.col("_ten")).drop("_ten")  # one row
    return df.unionByName(turned)
