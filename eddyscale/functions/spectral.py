"""Wavenumbers, masks, filters, bands and tapers, each as a column expression and in numpy.

A wavenumber is a closed form of its index, or a literal list's entry where an axis has one, so no
plan joins a grid table.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.types import GaussianFilter, Grid, OrszagTwoThirds, SharpSpectralFilter, ShellMagnitude, SmoothBands, TopHatFilter


def add(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def index(d: int, prefix: str = "i") -> Column:
    return F.col(f"{prefix}{d}")


def signed(i: Column, n: int) -> Column:
    """Index to integer wavenumber; the middle of an even axis is positive."""
    return F.when(i <= n // 2, i).otherwise(i - n)


def wavenumber(i: Column, n: int, length: float) -> Column:
    return signed(i, n) * F.lit(2 * math.pi / length)


def _given(grid: Grid, d: int) -> tuple[float, ...] | None:
    return None if grid.waves is None else grid.waves[d]


def wavenumbers(grid: Grid, prefix: str = "i") -> list[Column]:
    given = lambda own, d: F.get(F.array(*(F.lit(float(k)) for k in own)), index(d, prefix).cast("int"))
    return [wavenumber(index(d, prefix), n, grid.lengths[d]) if (own := _given(grid, d)) is None else given(own, d) for d, n in enumerate(grid.ns)]


def axis(n: int, length: float = 2 * math.pi) -> np.ndarray:
    i = np.arange(n)
    return np.where(i <= n // 2, i, i - n) * (2 * math.pi / length)


def axes(grid: Grid) -> list[np.ndarray]:
    return [axis(n, length) if (own := _given(grid, d)) is None else np.array(own, float) for d, (n, length) in enumerate(zip(grid.ns, grid.lengths, strict=True))]


def _dims(grid: Grid, geometry: ShellMagnitude) -> tuple[int, ...]:
    dims = tuple(range(grid.nd)) if geometry.dims is None else tuple(geometry.dims)
    if not dims or min(dims) < 0 or max(dims) >= grid.nd:
        raise ValueError(f"geometry dims {dims} of a grid of {grid.nd}")
    return dims


def magnitude(grid: Grid, geometry: ShellMagnitude = ShellMagnitude(), prefix: str = "i") -> Column:  # noqa: B008
    k = wavenumbers(grid, prefix)
    return F.sqrt(add([k[d] * k[d] for d in _dims(grid, geometry)]))


def magnitude_array(grid: Grid, geometry: ShellMagnitude = ShellMagnitude()) -> np.ndarray:  # noqa: B008
    k = np.meshgrid(*axes(grid), indexing="ij")
    return np.sqrt(sum(k[d] ** 2 for d in _dims(grid, geometry)))


def largest(grid: Grid, geometry: ShellMagnitude = ShellMagnitude()) -> float:  # noqa: B008
    own = axes(grid)
    return math.sqrt(sum(float(np.max(own[d] ** 2)) for d in _dims(grid, geometry)))


def kept(grid: Grid, dealiasing, prefix: str = "i") -> Column | None:
    """Modes that a dealiasing rule keeps; None if all."""
    tests = []
    for d, n in enumerate(grid.ns):
        own = dealiasing.keeps(n)
        near = sum(own) // 2 + 1  # of a symmetric rule: the first index that goes
        if all(own):
            continue
        if own == [min(i, n - i) < near for i in range(n)]:
            tests.append(F.least(index(d, prefix), n - index(d, prefix)) < near)
        else:
            tests.append(index(d, prefix).isin([i for i, x in enumerate(own) if x]))
    return reduce(lambda a, b: a & b, tests) if tests else None


def two_thirds(grid: Grid, prefix: str = "i") -> Column:
    return kept(grid, OrszagTwoThirds(), prefix)


def two_thirds_array(grid: Grid) -> np.ndarray:
    return reduce(np.logical_and, np.meshgrid(*(np.array(OrszagTwoThirds().keeps(n)) for n in grid.ns), indexing="ij"))


def dealiasing_mask(grid: Grid, rule: str = "twothirds", prefix: str = "i") -> Column:
    """The exported mask: a real third (any other rule: half) of the axis, which keeps more than the engine."""
    share = 1 / 3 if rule == "twothirds" else 0.5
    return reduce(lambda a, b: a & b, [F.least(index(d, prefix), n - index(d, prefix)) < n * share for d, n in enumerate(grid.ns)])


def filter_response(kind, k: Column, scale: float) -> Column:
    if callable(getattr(kind, "column", None)):
        return kind.column(k, scale)
    if isinstance(kind, SharpSpectralFilter):
        return F.when(F.abs(k) < math.pi / scale, 1.0).otherwise(0.0)
    if isinstance(kind, GaussianFilter):
        return F.exp(-k * k * (scale * scale / 24))
    if isinstance(kind, TopHatFilter):
        half = k * (scale / 2)
        return F.when(half == 0, 1.0).otherwise(F.sin(half) / half)
    raise TypeError(f"filter: {kind!r}")


def filter_array(kind, k: np.ndarray, scale: float) -> np.ndarray:
    k = np.asarray(k, float)
    if callable(getattr(kind, "array", None)):
        return kind.array(k, scale)
    if isinstance(kind, SharpSpectralFilter):
        return (np.abs(k) < math.pi / scale).astype(float)
    if isinstance(kind, GaussianFilter):
        return np.exp(-k * k * scale * scale / 24)
    if isinstance(kind, TopHatFilter):
        return np.sinc(k * scale / (2 * math.pi))
    raise TypeError(f"filter: {kind!r}")


def band_weights(bands: SmoothBands, kappa: Column) -> Column:
    """An array of one weight for each band, summing to one; zero at and below zero."""
    centers = F.array(*(F.lit(float(c)) for c in bands.centers))
    raw = F.transform(centers, lambda c: F.when(kappa > 0, F.exp(-F.pow(F.log(kappa / c), 2) / (2 * bands.logwidth**2))).otherwise(0.0))
    total = lambda r: F.aggregate(r, F.lit(0.0), lambda a, w: a + w)
    # through an array of one array, so that the weights are made once
    return F.get(F.transform(F.array(raw), lambda r: F.transform(r, lambda w: F.when(total(r) > 0, w / total(r)).otherwise(0.0))), F.lit(0))


def band_arrays(bands: SmoothBands, kappa: np.ndarray) -> np.ndarray:
    safe = np.where(kappa > 0, kappa, 1.0)
    raw = np.stack([np.exp(-np.log(safe / c) ** 2 / (2 * bands.logwidth**2)) for c in bands.centers]) * (kappa > 0)
    total = raw.sum(0)
    return np.where(total > 0, raw / np.where(total > 0, total, 1), 0.0)


def taper(kind: str, n: int, alpha: float = 0.5) -> np.ndarray:
    """Hamming, Hann or Tukey window of ``n`` points, symmetric."""
    return np.array([_taper_at(kind, j, n, alpha) for j in range(n)])


def _check_taper(kind: str, n: int, alpha: float) -> None:
    if kind not in ("hamming", "hann", "tukey"):
        raise ValueError(f"window: {kind!r}")
    if n < 2:
        raise ValueError("a window has two points at least")
    if kind == "tukey" and not 0 <= alpha <= 1:
        raise ValueError("alpha is from 0 to 1")


def _taper_at(kind: str, j: int, n: int, alpha: float) -> float:
    _check_taper(kind, n, alpha)
    wave = lambda x: math.cos(2 * math.pi * x)
    if kind == "hamming":
        return 0.54 - 0.46 * wave(j / (n - 1))
    if kind == "hann":
        return 0.5 - 0.5 * wave(j / (n - 1))
    edge = alpha * (n - 1) / 2
    near = min(j, n - 1 - j)
    return 1.0 if alpha == 0 or near >= edge else 0.5 * (1 - math.cos(math.pi * near / edge))


def taper_column(kind: str, j: Column, n: int, alpha: float = 0.5) -> Column:
    _check_taper(kind, n, alpha)
    if kind != "tukey":
        a = 0.54 if kind == "hamming" else 0.5
        return F.lit(a) - (1 - a) * F.cos(j * (2 * math.pi / (n - 1)))
    edge = alpha * (n - 1) / 2
    near = F.least(j, n - 1 - j)
    return F.lit(1.0) if alpha == 0 else F.when(near >= edge, 1.0).otherwise(0.5 * (1 - F.cos(near * (math.pi / edge))))
