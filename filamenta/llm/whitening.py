"""Embedding whitening by Chebyshev-filtered subspace iteration (operator 11).

Vectors become integers x = floor(256 c); the fit list has each distinct x once, as
blocks of binary rows in the shared folder. Every product with the covariance V is
one pass over those blocks: a task centres its rows and adds up (x - m)(x - m)'Q,
Spark sums the tasks' parts by dimension, and the driver sees the d x k result only.

1. A few Lanczos steps bound the spectrum from below.
2. Chebyshev's three-term recurrence, a pass a degree, grows a block of k vectors
   outside [bound, least Ritz value], so the unwanted spectrum is damped.
3. QR and Rayleigh-Ritz, with one pass, give eigenpairs and their residuals. Steps 2
   and 3 repeat until the wanted pairs are certified: their residuals are at rounding
   level, or no longer fall and bound the vectors' errors (residual over gap) by 1e-9 or
   are below 1e-12 of the largest eigenvalue (equal eigenvalues leave their axes open).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, small_batches

#: Components that are returned, further vectors of the block, Lanczos steps, most degrees of one filter, rounds after which an uncertified fit is an error.
COMPONENTS, GUARD, LANCZOS, DEGREE, ROUNDS = 4, 20, 12, 12, 60
#: Vectors of a block of the fit list; components' variances below this share of the trace count as zero.
BLOCK, FLAT = 1024, 1e-13

_OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double, deviation_exact string"


def finite(embedding: str = "embedding") -> Column:
    """True for vectors that hold neither null nor non-finite entries and are neither null nor empty."""
    e = F.col(embedding)
    fine = F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.coalesce(fine & (F.size(e) > 0), F.lit(False))


def scaled(embedding: str = "embedding") -> Column:
    """floor(256 c) of every entry as long; beyond the range of long its nearest end."""
    return F.transform(F.col(embedding), lambda c: F.floor(F.greatest(F.lit(-(2.0**63)), F.least(F.lit(2.0**63 - 1024), 256.0 * c.cast("double")))).cast("long"))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _blocks(d: int):
    """Rows of x as blocks (rows, x, high, low): little-endian int64, and sums by dimension of the upper and lower 32 bits, which can't overflow."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(0), d)
            for a in range(0, len(x), BLOCK):
                part = x[a : a + BLOCK]
                sums = [pa.array([s.sum(0)], pa.list_(pa.int64())) for s in (part >> 32, part & 0xFFFFFFFF)]
                yield pa.RecordBatch.from_arrays([pa.array([len(part)], pa.int64()), pa.array([part.astype("<i8").tobytes()], pa.binary()), *sums], ["rows", "x", "high", "low"])

    return pack


class FitList:
    """The fit list of a table of vectors: n, exact sums by dimension, and products with the covariance, each one pass."""

    def __init__(self, vectors: DataFrame, d: int):
        """vectors: column x, arrays of d longs."""
        self.d, self.passes = d, 0
        small_batches(vectors.sparkSession, 4096)
        self.blocks = keep(vectors.select("x").distinct().mapInArrow(_blocks(d), "rows long, x binary, high array<long>, low array<long>"), "fit")
        self.n = self.blocks.agg(F.sum("rows")).first()[0] or 0
        by_dimension = self.blocks.select(F.posexplode(F.arrays_zip("high", "low")).alias("j", "s")).groupBy("j").agg(F.sum("s.high").alias("high"), F.sum("s.low").alias("low"))
        self.sums = [0] * d
        for r in by_dimension.collect():  # a row for each dimension
            self.sums[r["j"]] = (r["high"] << 32) + r["low"]
        self.mean = np.array([s / self.n for s in self.sums]) if self.n else np.zeros(d)
        self.trace = self._summed(lambda c: (c * c).sum(0)[:, None], 1).sum() if self.n else 0.0

    def _summed(self, of: Callable[[np.ndarray], np.ndarray], columns: int) -> np.ndarray:
        """The mean over the fit list of what `of` sums up of centred rows: d x columns. Tasks add their blocks up, Spark the tasks' parts by dimension."""
        d, mean = self.d, self.mean
        names = [f"q{k}" for k in range(columns)]

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for x in batch.column(0):
                    c = np.frombuffer(x.as_py(), "<i8").reshape(-1, d) - mean
                    total = of(c) if total is None else total + of(c)
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(d, dtype=np.int32)), *(pa.array(np.ascontiguousarray(q)) for q in total.T)], ["j", *names])

        parts = self.blocks.select("x").mapInArrow(part, "j int, " + ", ".join(f"{q} double" for q in names))
        out = np.zeros((d, columns))
        for r in parts.groupBy("j").agg(*[F.sum(q).alias(q) for q in names]).collect():  # a row for each dimension
            out[r["j"]] = r[1:]
        self.passes += 1
        return out / self.n

    def product(self, q: np.ndarray) -> np.ndarray:
        """V q by one pass."""
        return self._summed(lambda c: c.T @ (c @ q), q.shape[1])


def lower_bound(product: Callable[[np.ndarray], np.ndarray], start: np.ndarray, steps: int) -> float:
    """A bound below the spectrum by Lanczos: the least Ritz value minus the norm of what the last step leaves, at least 0."""
    basis = [start / np.linalg.norm(start)]
    alpha, beta = [], []
    for _ in range(steps):
        w = product(basis[-1][:, None])[:, 0]
        alpha.append(basis[-1] @ w)
        for _ in range(2):
            for v in basis:
                w = w - (v @ w) * v
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    m = len(alpha)
    ritz = np.linalg.eigvalsh(np.diag(alpha) + np.diag(beta[: m - 1], 1) + np.diag(beta[: m - 1], -1))
    return max(0.0, float(ritz[0] - beta[m - 1]))


def filtered(product: Callable[[np.ndarray], np.ndarray], q: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """Chebyshev's polynomial of V on [low, high], scaled to 1 at top, applied to q by the three-term recurrence, a pass a degree."""
    centre, half = (high + low) / 2, max((high - low) / 2, 1e-300)
    sigma = first = half / (top - centre)
    before, now = q, (product(q) - centre * q) * (sigma / half)
    for _ in range(degree - 1):
        then = 1 / (2 / first - sigma)
        before, now = now, (product(now) - centre * now) * (2 * then / half) - sigma * then * before
        sigma = then
    return now


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, wanted: int, trace: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns, their images under V) of the wanted largest, certified."""
    k = min(d, wanted + GUARD)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((d, k)))[0]
    low = lower_bound(product, rng.standard_normal(d), min(LANCZOS, d)) if k < d else 0.0
    best, still = np.inf, 0
    for _ in range(ROUNDS):
        image = product(q)
        values, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, image = q @ turn, image @ turn
        residual = np.linalg.norm(image[:, :wanted] - q[:, :wanted] * values[:wanted], axis=0)
        top = max(values[0], 1e-300)
        gaps = np.array([min([abs(values[j] - v) for i, v in enumerate(values[: wanted + 1]) if i != j] or [top]) for j in range(wanted)])
        worst = residual.max() / top
        still = still + 1 if worst > best / 2 else 0
        best = min(best, worst)
        error = (residual / np.maximum(gaps, 1e-300)).max()
        flat = values[0] <= FLAT * max(trace, 1e-300)
        if k == d or flat or worst <= 4e-16 * math.sqrt(d) or still >= 2 and (error <= 1e-9 or worst <= 1e-12):
            return values[:wanted], q[:, :wanted], image[:, :wanted]
        high = values[-1] if values[-1] < values[wanted - 1] else (values[wanted - 1] + low) / 2
        low = min(low, 0.999 * high)
        reach = (values[wanted - 1] - (high + low) / 2) / max((high - low) / 2, 1e-300)
        growth = math.log(reach + math.sqrt(max(reach * reach - 1, 0))) if reach > 1 else 0.05
        degree = max(2, min(DEGREE, math.ceil(math.log(max(worst, 1e-16) / 1e-16) / max(growth, 1e-3))))
        q = np.linalg.qr(filtered(product, q, low, high, values[0], degree))[0]
    raise ArithmeticError(f"the components of {d} dimensions aren't certified after {ROUNDS} rounds: residual {worst:.1e}")


def _digests(d: int, n: int, sums: list[int], mean: np.ndarray, values: np.ndarray, axes: np.ndarray, explained: list[float], identity: float | None):
    """The result rows of batches (vec_id, x)."""
    k = len(values)
    positive = np.array([e is not None for e in explained])
    scale = np.where(positive, 1 / np.sqrt(np.where(positive, values, 1.0)), np.nan)
    long_sums = np.array(sums, object)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column(1), d)
            reach = n * max(abs(int(x.max())), abs(int(x.min()))) + max(map(abs, sums))
            if d * reach * reach < 1 << 63:
                away = n * x - long_sums.astype(np.int64)
                deviation, exact = pa.array((away * away).sum(1)), pa.nulls(m, pa.string())
            else:  # longs can't hold the steps, Python's integers can
                away = n * x.astype(object) - long_sums
                full = [int(v) for v in (away * away).sum(1)]
                fits = [v < 1 << 63 for v in full]
                deviation, exact = pa.array([v if f else None for v, f in zip(full, fits)], pa.int64()), pa.array([None if f else str(v) for v, f in zip(full, fits)], pa.string())
            white = ((x - mean) @ axes) * scale
            repeated = pa.array(np.repeat(np.arange(m), k))
            whitened = white.ravel()
            columns = [
                batch.column(0).take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)), deviation.take(repeated),
                pa.array(whitened, pa.float64(), mask=np.isnan(whitened)), pa.array(explained * m, pa.float64()), pa.array([identity] * (m * k), pa.float64()), exact.take(repeated),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error", "deviation_exact"])

    return emit


def whiten(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_exact) of every usable row of embeddings (vec_id, embedding; further columns are ignored).

    Vectors that are null, empty or hold a null or non-finite entry are dropped, as are
    those with another number of entries than most have (ties: the larger number).
    Repeated rows, repeated and null vec_ids come back as they came; equal vectors
    count once in the fit. There are as many components as dimensions if those are
    fewer. A component without variance (all vectors equal, or fewer distinct ones
    than components) has null for whitened and 0 for explained, and takes no part in
    identity_error, which is null if none has any. deviation is null where a long
    can't hold it; deviation_exact then has its digits. An empty table gives an empty
    result.
    """
    spark = embeddings.sparkSession
    some = embeddings.where(finite()).select(F.col("vec_id").cast("long").alias("vec_id"), scaled().alias("x"))
    lengths = embeddings.where(finite()).groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], _OUT)
    d = lengths[0]["d"]
    some = some.where(F.size("x") == d)
    fit = FitList(some, d)
    wanted = min(components, d)
    values, axes, images = leading(fit.product, d, wanted, fit.trace)
    discard(fit.blocks)
    sign = np.where(np.take_along_axis(axes, np.abs(axes).argmax(0)[None], 0)[0] < 0, -1, 1)  # the entry of largest size is positive
    axes, images = axes * sign, images * sign
    real = values > FLAT * max(fit.trace, 1e-300)
    identity = None
    if real.any():
        v = (axes.T @ images)[np.ix_(real, real)] / np.sqrt(np.outer(values[real], values[real]))
        identity = float(np.abs(v - np.eye(len(v))).max())
    explained = [float(e / fit.trace) if f else None for e, f in zip(values, real)]
    emit = _digests(d, fit.n, fit.sums, fit.mean, values, axes, explained, identity)
    return some.mapInArrow(emit, _OUT).withColumn("explained", F.coalesce("explained", F.lit(0.0)))
