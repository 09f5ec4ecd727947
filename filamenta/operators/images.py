"""Fourier kernels on images that are array columns: Spark deals the rows, a batch of equal images is one numpy call."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _mapped(df: DataFrame, key: str, values: str, kernel: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...]) -> DataFrame:
    """(key, values) with the kernel's result of stacked images; null images and those of another size come out null."""
    size = int(np.prod(shape))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            fine = [k for k, v in enumerate(part[values]) if v is not None and len(v) == size]
            out: list = [None] * len(part)
            if fine:
                done = kernel(np.stack([np.asarray(part[values].iloc[k], float) for k in fine]).reshape(len(fine), *shape))
                for k, v in zip(fine, done.reshape(len(fine), -1)):
                    out[k] = v.tolist()
            yield pd.DataFrame({key: part[key], values: pd.Series(out, index=part.index, dtype=object)})

    return df.select(key, values).mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, `{values}` array<double>")


def _radii(shape: tuple[int, ...]) -> np.ndarray:
    """Spatial frequencies of a transform in cycles a pixel."""
    return np.sqrt(sum(f * f for f in np.meshgrid(*[np.fft.fftfreq(n) for n in shape], indexing="ij")))


def pass_filtered(df: DataFrame, key: str, values: str, shape: tuple[int, ...], apix: float, low_pass: float = 0.0, high_pass: float = 0.0) -> DataFrame:
    """Images without what is finer than low_pass or coarser than high_pass angstrom, by Gaussian edges that are one half there; 0 leaves a side out."""
    q = _radii(shape)
    gain = np.ones(shape)
    if low_pass > 0:
        gain *= np.exp(-np.log(2) * (q * low_pass / apix) ** 2)
    if high_pass > 0:
        gain *= 1 - np.exp(-np.log(2) * (q * high_pass / apix) ** 2)
    axes = tuple(range(1, len(shape) + 1))
    return _mapped(df, key, values, lambda x: np.fft.ifftn(np.fft.fftn(x, axes=axes) * gain, axes=axes).real, shape)


def structural_factors(df: DataFrame, key: str, values: str, shape: tuple[int, ...]) -> DataFrame:
    """The sums of squared amplitudes of each image over rings one sample of its longest side wide, from the centre out."""
    bins = np.floor(_radii(shape) * max(shape) + 0.5).astype(int).ravel()
    axes = tuple(range(1, len(shape) + 1))

    def kernel(x: np.ndarray) -> np.ndarray:
        power = np.abs(np.fft.fftn(x, axes=axes).reshape(len(x), -1)) ** 2
        return np.stack([np.bincount(bins, p) for p in power])

    return _mapped(df, key, values, kernel, shape)


def fourier_cropped(df: DataFrame, key: str, values: str, shape: tuple[int, ...], new: tuple[int, ...]) -> DataFrame:
    """Images of the same extent with fewer (or more) pixels, by cutting (or filling) their transforms; means stay."""
    axes = tuple(range(1, len(shape) + 1))

    def kernel(x: np.ndarray) -> np.ndarray:
        f = np.fft.fftshift(np.fft.fftn(x, axes=axes), axes=axes)
        for axis, (n, m) in enumerate(zip(shape, new), 1):
            a, b = n // 2 - m // 2, n // 2 - m // 2 + m
            f = np.take(f, range(max(a, 0), min(b, n)), axis)
            f = np.pad(f, [(0, 0)] * axis + [(max(-a, 0), max(b - n, 0))] + [(0, 0)] * (len(shape) - axis))
        return np.fft.ifftn(np.fft.ifftshift(f, axes=axes), axes=axes).real * (np.prod(new) / np.prod(shape))

    return _mapped(df, key, values, kernel, shape)


def shifted(df: DataFrame, key: str, values: str, shape: tuple[int, ...], by: tuple[float, ...]) -> DataFrame:
    """Images moved by (fractions of) pixels along each axis, around their edges, by phases."""
    axes = tuple(range(1, len(shape) + 1))
    turn = sum(f * b for f, b in zip(np.meshgrid(*[np.fft.fftfreq(n) for n in shape], indexing="ij"), by))
    return _mapped(df, key, values, lambda x: np.fft.ifftn(np.fft.fftn(x, axes=axes) * np.exp(-2j * np.pi * turn), axes=axes).real, shape)


def best_shift(pairs: DataFrame, key: str, one: str, other: str, shape: tuple[int, int]) -> DataFrame:
    """(key, dy, dx, peak): the whole shift of other that brings it onto one, at the highest phase correlation."""
    ny, nx = shape

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            a, b = (np.stack([np.asarray(v, float) for v in part[c]]).reshape(-1, ny, nx) if len(part) else np.zeros((0, ny, nx)) for c in (one, other))
            f = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
            c = np.fft.ifft2(f / np.maximum(np.abs(f), 1e-12)).real.reshape(len(part), -1)
            at = c.argmax(1) if len(part) else np.zeros(0, int)
            y, x = at // nx, at % nx
            yield pd.DataFrame({key: part[key], "dy": np.where(y > ny // 2, y - ny, y), "dx": np.where(x > nx // 2, x - nx, x), "peak": c[np.arange(len(part)), at]})

    return pairs.select(key, one, other).mapInPandas(run, f"`{key}` {pairs.schema[key].dataType.simpleString()}, dy int, dx int, peak double")


def tapered(df: DataFrame, key: str, values: str, shape: tuple[int, int], start: tuple[float, float], slope: float = 0.1) -> DataFrame:
    """Images that fall to 0 as a cosine, from the part start of the way between centre and edge on over the part slope of it, along each axis whose start lies between 0 and 1."""
    gain = np.ones(shape)
    for axis, (n, f) in enumerate(zip(shape, start)):
        if 0 < f < 1:
            away = np.abs((np.arange(n) - n // 2) / (n // 2))
            fall = np.where(away < f, 1.0, np.where(away > f + slope, 0.0, (1 + np.cos((away - f) / slope * np.pi)) / 2))
            gain *= fall.reshape([-1 if k == axis else 1 for k in range(2)])
    return _mapped(df, key, values, lambda x: x * gain, shape)


def phases_randomised(df: DataFrame, key: str, values: str, shape: tuple[int, ...], apix: float, from_resolution: float, seed: int = 1) -> DataFrame:
    """Images whose amplitudes stay and whose phases beyond a resolution in angstrom are those of noise; the noise is the same for all images of a seed."""
    far = _radii(shape) > apix / from_resolution
    noise = np.fft.fftn(np.random.default_rng(seed).normal(size=shape))
    phase = noise / np.maximum(np.abs(noise), 1e-12)
    axes = tuple(range(1, len(shape) + 1))

    def kernel(x: np.ndarray) -> np.ndarray:
        f = np.fft.fftn(x, axes=axes)
        return np.fft.ifftn(np.where(far, np.abs(f) * phase, f), axes=axes).real

    return _mapped(df, key, values, kernel, shape)
