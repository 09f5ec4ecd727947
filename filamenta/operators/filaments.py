"""Filament analytics: windows over (micrograph, tube) ordered by track position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.angles import circular_mean, circular_std, wrap
from .ranking import numbered, running_before

KEYS = ["mic", "tube"]


def _along(*order: str):
    return Window.partitionBy(*KEYS).orderBy(*order)


def segment_gaps(df: DataFrame) -> DataFrame:
    return df.withColumn("gap", F.col("track") - F.lag("track").over(_along("track", "rid"))).where("gap is not null")


def inter_segment_distance(df: DataFrame) -> DataFrame:
    """One row: median, mean and population deviation of gaps."""
    return segment_gaps(df).agg(F.median("gap").alias("median_gap"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("std_gap"))


def full_segment_count(df: DataFrame) -> DataFrame:
    """One row: the segments that filaments of these lengths have at the median distance; halves round to even."""
    gap = inter_segment_distance(df).select("median_gap")
    lengths = df.groupBy(*KEYS).agg(F.max("track").alias("_l"))
    return lengths.crossJoin(F.broadcast(gap)).agg(F.sum(F.rint(F.col("_l") / F.col("median_gap")) + 1).cast("long").alias("segments"))


def lengths_by_index(df: DataFrame, index: str, spacing: float) -> DataFrame:
    """Filament lengths where no track is known: from the range of segment numbers and their distance."""
    return df.groupBy(*KEYS).agg(((F.max(index) - F.min(index) + 1) * spacing).alias("longest"))


def rate_variance(df: DataFrame, angle: str = "rot") -> DataFrame:
    """Per filament: the deviation of the angle's wrapped change over the way between neighbours, and median and median absolute deviation of the unwrapped rates between all pairs.

    Pairs stay inside a filament, whose length bounds them.
    """
    w = _along("track", "rid")
    step = wrap(F.col(angle) - F.lag(angle).over(w)) / F.nullif(F.col("track") - F.lag("track").over(w), F.lit(0.0))
    steps = df.withColumn("_step", step).groupBy(*KEYS).agg(F.stddev_pop("_step").alias("rate_std"))
    u = unwrapped(df, angle).select(*KEYS, "rid", "track", "unwrapped")
    a, b = u.alias("a"), u.alias("b")
    pairs = a.join(b, (F.col("a.mic") == F.col("b.mic")) & (F.col("a.tube") == F.col("b.tube")) & (F.col("a.track") < F.col("b.track")))
    rates = pairs.select("a.mic", "a.tube", ((F.col("b.unwrapped") - F.col("a.unwrapped")) / (F.col("b.track") - F.col("a.track"))).alias("_rate"))
    middle = rates.groupBy(*KEYS).agg(F.median("_rate").alias("rate_median"))
    away = rates.join(middle, KEYS).groupBy(*KEYS).agg(F.max("rate_median").alias("rate_median"), F.median(F.abs(F.col("_rate") - F.col("rate_median"))).alias("rate_mad"))
    return steps.join(away, KEYS, "left")


def helix_table(df: DataFrame, image: str) -> DataFrame:
    """(mic, tube, length, classes, image, rank): of each filament its track length, its classes from the most segments to the fewest, its first image; ranks by descending length."""
    counts = df.groupBy(*KEYS, "cls").agg(F.count("*").alias("n"), F.max("track").alias("last"), F.min("track").alias("first"), F.min_by(image, "rid").alias("image"), F.min("rid").alias("rid"))
    per = counts.groupBy(*KEYS).agg((F.max("last") - F.min("first")).alias("length"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "cls"))), lambda s: s["cls"].cast("string")), " ").alias("classes"), F.min_by("image", "rid").alias("image"))
    return numbered(per.withColumn("_less", -F.col("length")), ["_less", *KEYS], "rank").drop("_less")


def twist_histogram(df: DataFrame, bins: int, low: float, high: float, rise: float = 4.75) -> DataFrame:
    """(bin, n, log_n, twist_1 .. twist_4): pair distances counted in equal bins of [low, high], the last closed, log10(1 + n), and the twist at each bin's centre for symmetries C1 to C4.

    Bins without a pair are there with 0.
    """
    width = (high - low) / bins
    d = pair_distances(df).where((F.col("distance") >= low) & (F.col("distance") <= high))
    at = F.least(F.floor((F.col("distance") - low) / width), F.lit(bins - 1))
    counts = d.groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(counts, "bin", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    center = F.lit(low) + (F.col("bin") + 0.5) * width
    return every.select("bin", "n", F.log10(F.col("n") + 1.0).alias("log_n"), *[(360.0 / (center * c / rise)).alias(f"twist_{c}") for c in range(1, 5)])


def tube_lengths(df: DataFrame) -> DataFrame:
    return df.groupBy(*KEYS).agg(F.max("track").alias("longest"), (F.max("track") - F.min("track")).alias("span"), F.count("*").alias("segments"))


def break_filaments(df: DataFrame, most: int) -> DataFrame:
    """Filaments cut into chunks of at most so many segments along the track; chunk ids from 0 in order of first appearance of filament, then chunk."""
    cut = df.withColumn("_chunk", F.floor((F.row_number().over(_along("track", "rid")) - 1) / most))
    filaments = df.groupBy(*KEYS).agg(F.min("rid").alias("_first"), F.ceil(F.count("*") / most).alias("_chunks"))
    before = running_before(filaments, ["_first"], F.col("_chunks"), "_before").select(*KEYS, "_before")
    return cut.join(before, KEYS).withColumn("chunk_id", F.col("_before") + F.col("_chunk")).drop("_chunk", "_before")


def rebased(df: DataFrame) -> DataFrame:
    low = df.groupBy(*KEYS).agg(F.min("track").alias("_low"))
    return df.join(low, KEYS).withColumn("track0", F.col("track") - F.col("_low")).drop("_low")


def angle_variance(df: DataFrame) -> DataFrame:
    """Per filament: circular mean and deviation of tilt, and half the deviation of twice psi, which opposite polarities share."""
    return df.groupBy(*KEYS).agg(circular_mean(F.col("tilt")).alias("tilt_mean"), circular_std(F.col("tilt")).alias("tilt_std"), (circular_std(2 * F.col("psi")) / 2).alias("psi_std"))


def unwrapped(df: DataFrame, angle: str = "rot", period: float = 360.0) -> DataFrame:
    """The angle along the track without jumps of more than half a period."""
    step = wrap(F.col(angle) - F.lag(angle).over(_along("track", "rid")), period)
    first = F.first(angle).over(_along("track", "rid"))
    stepped = df.withColumn("_step", F.coalesce(step, F.lit(0.0))).withColumn("_first", first)
    total = F.sum("_step").over(_along("track", "rid").rowsBetween(Window.unboundedPreceding, 0))
    return stepped.withColumn("unwrapped", F.col("_first") + total).drop("_step", "_first")


def pair_distances(df: DataFrame) -> DataFrame:
    """Distances of all pairs of segments of one class in one filament with the same polarity.

    Pairs are the result itself; a filament's length, not the table's, bounds them.
    A difference of 90 degrees isn't the same polarity. A turn is added to either sign,
    as in SQL, so that both decide alike where last bits tell 90 from less.
    """
    a, b = df.alias("a"), df.alias("b")
    same = (F.col("a.mic") == F.col("b.mic")) & (F.col("a.tube") == F.col("b.tube")) & (F.col("a.cls") == F.col("b.cls"))
    polar = F.abs(((F.col("a.psi") - F.col("b.psi") + 180) % 360 + 360) % 360 - 180) < 90
    return a.join(b, same & (F.col("a.track") < F.col("b.track")) & polar).select("a.mic", "a.tube", "a.cls", (F.col("b.track") - F.col("a.track")).alias("distance"))


def _fitted(x: np.ndarray, o: np.ndarray, slopes: np.ndarray, period: float) -> tuple[np.ndarray, np.ndarray]:
    """(intercepts, sums of squared wrapped residuals) of lines of these slopes through angles o at x, in order.

    The intercept is the mean of the residuals without jumps of more than half a period.
    """
    r = o - slopes[:, None] * x
    step = np.diff(r, axis=1)
    turns = np.floor(step / period + 0.5).cumsum(axis=1) * period
    b = r[:, 0] + np.concatenate([np.zeros((len(slopes), 1)), r[:, 1:] - turns - r[:, :1]], axis=1).mean(axis=1)
    d = r - b[:, None]
    d -= np.floor(d / period + 0.5) * period
    return b, (d * d).sum(axis=1)


def fit_slopes(df: DataFrame, keys: list[str], least: int = 25, slopes: int = 1201, reach: float = 1.1, period: float = 360.0, order: tuple[str, ...] = ("track", "rid")) -> DataFrame:
    """(keys, slope, intercept, sse, segments): for each filament of at least so many segments the line of angle rot along track, of a grid of slopes, with the least sum of squared wrapped residuals; ties to the smaller slope.

    A filament's tracks and angles meet in one row, and tasks try the grid on whole
    batches of filaments; nothing is repeated for each slope.
    """
    grid = np.linspace(-reach, reach, slopes)
    placed = F.sort_array(F.collect_list(F.struct(*order, F.pmod(F.col("rot"), F.lit(period)).alias("_angle"))))
    lines = df.groupBy(*keys).agg(F.count("*").alias("segments"), placed.alias("_p")).where(F.col("segments") >= least)
    lines = lines.select(*keys, "segments", F.transform("_p", lambda p: p[order[0]].cast("double")).alias("_x"), F.transform("_p", lambda p: p["_angle"].cast("double")).alias("_o"))

    def fit(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            best = []
            for x, o in zip(part["_x"], part["_o"]):
                x, o = np.asarray(x, float), np.asarray(o, float)
                b, sse = (np.concatenate(v) for v in zip(*[_fitted(x, o, grid[a : a + 128], period) for a in range(0, slopes, 128)]))
                k = int(np.argmin(np.round(sse, 6)))
                best.append((grid[k], b[k], sse[k]))
            yield pd.concat([part[[*keys, "segments"]].reset_index(drop=True), pd.DataFrame(best, columns=["slope", "intercept", "sse"], dtype=float)], axis=1)

    kinds = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return lines.mapInPandas(fit, f"{kinds}, segments long, slope double, intercept double, sse double")


def best_slope(df: DataFrame, keys: list[str], least: int = 25, slopes: int = 1201, reach: float = 1.1, period: float = 360.0) -> DataFrame:
    """(keys, slope, variance): the slope of fit_slopes() and the mean of its squared wrapped residuals."""
    return fit_slopes(df, keys, least, slopes, reach, period).select(*keys, "slope", (F.col("sse") / F.col("segments")).alias("variance"))


def symmetry_guess(df: DataFrame) -> int:
    """The symmetry that the breadth of all rot angles tells: 360 over it, rounded down from 0.3 above; at least 2."""
    low, high = df.agg(F.min("rot"), F.max("rot")).first()
    guess = int(360.0 / (high - low) + 0.3) if high is not None and high > low else 1
    return max(2, guess)


def angular_consistency(df: DataFrame, keys: list[str], slope: float, period: float, least: int = 25) -> DataFrame:
    """df with filament_slope, filament_error and segment_error, for filaments of at least so many segments.

    Lines of slope and -slope are laid through the angle rot along track; the one with
    the smaller sum of absolute wrapped distances stays (ties: slope). segment_error is
    a row's distance, filament_error their mean.
    """
    angle = F.pmod(F.col("rot"), F.lit(period))
    residual = {s: angle - F.lit(s * abs(slope)) * F.col("track") for s in (1, -1)}
    fits = df.groupBy(*keys).agg(F.count("*").alias("_n"), *[F.avg(F.pmod(r, F.lit(period))).alias(f"_b{k}") for k, r in enumerate(residual.values())]).where(F.col("_n") >= least)
    rows = df.join(fits, keys)
    for k, r in enumerate(residual.values()):
        rows = rows.withColumn(f"_e{k}", F.abs(wrap(r - F.col(f"_b{k}"), period)))
    sums = rows.groupBy(*keys).agg(F.sum("_e0").alias("_s0"), F.sum("_e1").alias("_s1"), F.count("*").alias("_m"))
    up = F.col("_s0") <= F.col("_s1")
    pick = lambda a, b: F.when(up, a).otherwise(b)
    out = rows.join(sums, keys)
    return out.select(*[f"`{c}`" for c in df.columns], pick(F.lit(abs(slope)), F.lit(-abs(slope))).alias("filament_slope"), pick(F.col("_s0") / F.col("_m"), F.col("_s1") / F.col("_m")).alias("filament_error"), pick(F.col("_e0"), F.col("_e1")).alias("segment_error"))


def two_gaussians(df: DataFrame, value: str, bins: int = 50, rounds: int = 200) -> tuple[tuple[float, float, float], tuple[float, float, float]]:
    """(weight, mean, deviation) of the two normal distributions, the lower mean first, that describe a histogram of value best.

    Spark counts the histogram; expectation and maximisation run over its bins.
    """
    low, high = df.agg(F.min(value), F.max(value)).first()
    if low is None or low == high:
        one = (1.0, float(low), 0.0) if low is not None else (0.0, 0.0, 0.0)
        return one, (0.0, one[1], 0.0)
    width = (high - low) / bins
    at = F.least(F.floor((F.col(value) - low) / width), F.lit(bins - 1))
    counts = np.zeros(bins)
    for r in df.where(F.col(value).isNotNull()).groupBy(at.alias("bin")).agg(F.count("*").alias("n")).collect():  # a row a bin
        counts[r["bin"]] = r["n"]
    x = low + (np.arange(bins) + 0.5) * width
    share = counts / counts.sum()
    middle, spread = (share * x).sum(), np.sqrt((share * (x - (share * x).sum()) ** 2).sum())
    w, m, s = np.array([0.5, 0.5]), np.array([middle - spread, middle + spread]), np.full(2, spread)
    for _ in range(rounds):
        d = w / s * np.exp(-0.5 * ((x[:, None] - m) / s) ** 2) + 1e-300
        r = d / d.sum(1, keepdims=True) * share[:, None]
        w = r.sum(0)
        m = (r * x[:, None]).sum(0) / w
        s = np.maximum(np.sqrt((r * (x[:, None] - m) ** 2).sum(0) / w), width / 4)
    return tuple((float(w[k]), float(m[k]), float(s[k])) for k in np.argsort(m))


def l1_core(df: DataFrame, keys: list[str], value: str, k: int) -> DataFrame:
    """(keys, center, l1): of all runs of k neighbouring values in sorted order that with the least sum of distances from its median, and that median; ties to the smaller one.

    Sums of the values before and after the middle come from running sums, so a run costs
    no more than its ends.
    """
    w = Window.partitionBy(*keys).orderBy(value)
    half, upper = k // 2, (k + 1) // 2
    total = F.sum(value).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(*keys, value, F.row_number().over(w).alias("_i"), total.alias("_s"))
    last = lambda c, n: F.lead(c, n).over(Window.partitionBy(*keys).orderBy("_i"))
    begin = F.col("_s") - F.col(value)
    low = last("_s", half - 1) - begin if half else F.lit(0.0)
    high = last("_s", k - 1) - last("_s", upper - 1)
    center = last(value, upper - 1) if k % 2 else (last(value, half - 1) + last(value, half)) / 2
    runs = rows.select(*keys, center.alias("center"), F.round(high - low, 9).alias("l1"))
    return runs.where("l1 is not null").groupBy(*keys).agg(F.min(F.struct("l1", "center")).alias("b")).select(*keys, F.col("b.center").alias("center"), F.col("b.l1").alias("l1"))


def resampled(df: DataFrame, spacing: float) -> DataFrame:
    """Positions every spacing along each filament's total-least-squares line through (x, y), with x, y there.

    The line's angle is half of atan2(2 Sxy, Sxx - Syy), turned towards the last segment.
    """
    ends = df.groupBy(*KEYS).agg(
        F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.covar_pop("x", "y").alias("sxy"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"),
        F.min_by(F.struct("x", "y"), F.struct("track", "rid")).alias("a"), F.max_by(F.struct("x", "y"), F.struct("track", "rid")).alias("b"),
    )
    angle = F.atan2(2 * F.col("sxy"), F.col("sxx") - F.col("syy")) / 2
    line = ends.withColumn("ux", F.cos(angle)).withColumn("uy", F.sin(angle))
    along = (F.col("b.x") - F.col("a.x")) * F.col("ux") + (F.col("b.y") - F.col("a.y")) * F.col("uy")
    line = line.withColumn("_l", along).withColumn("_s", F.when(F.col("_l") < 0, -1.0).otherwise(1.0))
    start = (F.col("a.x") - F.col("cx")) * F.col("ux") + (F.col("a.y") - F.col("cy")) * F.col("uy")
    line = line.withColumn("_start", start).withColumn("k", F.explode(F.sequence(F.lit(0), F.floor(F.abs("_l") / spacing).cast("int"))))
    at = F.col("_start") + F.col("_s") * F.col("k") * spacing
    return line.select(*KEYS, "k", (F.col("k") * F.lit(float(spacing))).alias("track"), (F.col("cx") + at * F.col("ux")).alias("x"), (F.col("cy") + at * F.col("uy")).alias("y"))


def resampled_rows(df: DataFrame, spacing: float) -> DataFrame:
    """df with a row at every spacing along each filament's line: k, track, x and y of resampled(), all other columns from the filament's k-th row in order, or its last one where it has fewer."""
    w = Window.partitionBy(*KEYS).orderBy("track", "rid")
    rows = df.withColumn("_n", F.row_number().over(w) - 1)
    counts = df.groupBy(*KEYS).agg((F.count("*") - 1).alias("_last"))
    places = resampled(df, spacing).join(counts, KEYS).withColumn("_n", F.least(F.col("k"), F.col("_last"))).drop("_last")
    rest = [c for c in df.columns if c not in (*KEYS, "track", "x", "y")]
    out = places.join(rows.select(*KEYS, "_n", *[F.col(f"`{c}`") for c in rest]), [*KEYS, "_n"])
    return out.select("k", *[F.col(f"`{c}`") for c in df.columns])


def _rates(df: DataFrame, angle: str) -> DataFrame:
    """(mic, tube, rate): sizes of the angle's change over the way for all pairs of a filament's segments at different places, its angle without jumps."""
    u = unwrapped(df, angle).select(*KEYS, "track", "unwrapped")
    a, b = u.alias("a"), u.alias("b")
    pairs = a.join(b, (F.col("a.mic") == F.col("b.mic")) & (F.col("a.tube") == F.col("b.tube")) & (F.col("a.track") < F.col("b.track")))
    return pairs.select("a.mic", "a.tube", F.abs((F.col("b.unwrapped") - F.col("a.unwrapped")) / (F.col("b.track") - F.col("a.track"))).alias("rate"))


def angle_quality(df: DataFrame, qualities: tuple[str, ...] = (), angle: str = "rot") -> DataFrame:
    """Per filament: segments; tilt_mean, tilt_std and psi_std of angle_variance(); rot_std: circular deviation of the angle's wrapped change over the way to the next segment; rate_median and rate_mad: median size of the rates of all pairs and median distance from it; mean and population deviation of each quality column.

    A filament without two places has 0 for rot_std and both rates. Null angles and
    qualities take no part. Pairs stay inside a filament, whose length bounds them, and
    are aggregated where they are joined.
    """
    step = wrap(F.col(angle) - F.lag(angle).over(_along("track", "rid"))) / F.nullif(F.col("track") - F.lag("track").over(_along("track", "rid")), F.lit(0.0))
    own = [f(c).alias(f"{c}_{n}") for c in qualities for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    spread = F.when(F.count("_step") > 0, circular_std(F.col("_step"))).otherwise(0.0).alias("rot_std")
    per = df.withColumn("_step", step).groupBy(*KEYS).agg(F.count("*").alias("segments"), circular_mean(F.col("tilt")).alias("tilt_mean"), circular_std(F.col("tilt")).alias("tilt_std"), (circular_std(2 * F.col("psi")) / 2).alias("psi_std"), spread, *own)
    rates = _rates(df.where(F.col(angle).isNotNull() & F.col("track").isNotNull()), angle)
    middle = rates.groupBy(*KEYS).agg(F.median("rate").alias("rate_median"))
    away = rates.join(middle, KEYS).groupBy(*KEYS).agg(F.max("rate_median").alias("rate_median"), F.median(F.abs(F.col("rate") - F.col("rate_median"))).alias("rate_mad"))
    out = per.join(away, KEYS, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("rate_median", "rate_mad")})


def with_angle_sigmas(df: DataFrame, names: tuple[str, str, str] = ("tilt_sigma", "psi_sigma", "rot_sigma"), angle: str = "rot") -> DataFrame:
    """df with the deviations of its filament's tilt, psi and change of rot, to two digits. Rows without a filament have nulls."""
    step = wrap(F.col(angle) - F.lag(angle).over(_along("track", "rid"))) / F.nullif(F.col("track") - F.lag("track").over(_along("track", "rid")), F.lit(0.0))
    spread = F.when(F.count("_step") > 0, circular_std(F.col("_step"))).otherwise(0.0)
    per = df.withColumn("_step", step).groupBy(*KEYS).agg(*[F.round(c, 2).alias(n) for c, n in zip((circular_std(F.col("tilt")), circular_std(2 * F.col("psi")) / 2, spread), names)])
    return df.drop(*names).join(per, KEYS, "left")


def lengths_with_box(df: DataFrame, box: float) -> DataFrame:
    """(mic, tube, length): the track from the first to the last segment and one box, as the ends of both reach half a box further."""
    return df.groupBy(*KEYS).agg((F.max("track") - F.min("track") + float(box)).alias("length"))
