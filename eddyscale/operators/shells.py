"""Shell construction on the driver, shell assignment as an expression."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import CustomBinning, DyadicBinning, Grid, LinearBinning, LogarithmicBinning, ShellMagnitude


def shell_edges(binning, k_max: float) -> list[float]:
    if callable(getattr(binning, "edges_to", None)):
        return [float(e) for e in binning.edges_to(k_max)]
    if isinstance(binning, CustomBinning):
        edges = list(binning.edges)
        if edges != sorted(edges):
            raise ValueError("edges must ascend")
        return edges
    if k_max <= 0:
        raise ValueError("k_max must be positive")
    if isinstance(binning, LinearBinning):
        if binning.dk <= 0:
            raise ValueError("dk must be positive")
        # by multiples, not by sums
        edges = [n * binning.dk for n in range(math.floor(k_max / binning.dk * (1 + 1e-15)) + 1)]
        return edges if edges[-1] >= k_max else [*edges, k_max]
    if isinstance(binning, DyadicBinning):
        binning = LogarithmicBinning(binning.k0, 2.0)
    if isinstance(binning, LogarithmicBinning):
        if binning.k0 <= 0 or binning.ratio <= 1 or k_max < binning.k0:
            raise ValueError("k0 must be positive, ratio over 1, k_max at least k0")
        # one shell beyond the last whole ratio; one less where the logarithm was rounded up to it
        last = 1 + math.floor(math.log(k_max / binning.k0) / math.log(binning.ratio))
        last -= last > 1 and binning.k0 * binning.ratio ** (last - 1) > k_max
        return [binning.k0 * binning.ratio**n for n in range(last + 1)]
    raise TypeError(f"binning: {binning!r}")


def shell_centers(binning, edges: list[float]) -> list[float]:
    if len(edges) < 2:
        raise ValueError("no shells")
    if callable(getattr(binning, "centers", None)):
        return [float(c) for c in binning.centers(edges)]
    pairs = list(zip(edges, edges[1:], strict=False))
    if isinstance(binning, (LogarithmicBinning, DyadicBinning)):
        return [math.sqrt(a * b) for a, b in pairs]
    return [(a + b) / 2 for a, b in pairs]


def n_shells(edges: list[float]) -> int:
    return len(edges) - 1


def default_binning(grid: Grid) -> LinearBinning:
    """Width: the least non-zero wavenumber of any axis."""
    values = np.abs(np.concatenate(spectral.axes(grid)))
    values = values[values > 0]
    return LinearBinning(float(values.min()) if len(values) else 1.0)


def edges_of(grid: Grid, binning=None, geometry: ShellMagnitude = ShellMagnitude()) -> tuple[object, list[float]]:  # noqa: B008
    binning = binning or default_binning(grid)
    return binning, shell_edges(binning, spectral.largest(grid, geometry) or 1.0)


def shell_of(kappa: Column, edges: list[float]) -> Column:
    """Shell from 1, half open; 0 outside all of them."""
    if len(edges) < 2:
        raise ValueError("no shells")
    # edges ascend: the number of edges at or below, if it isn't all of them
    below = F.size(F.filter(F.array(*map(F.lit, map(float, edges))), lambda e: e <= kappa))
    return F.when(kappa < edges[-1], below).otherwise(0).cast("int")


def shell_array(kappa: np.ndarray, edges: list[float]) -> np.ndarray:
    at = np.searchsorted(np.asarray(edges, float), kappa, side="right")
    return np.where(at < len(edges), at, 0)


def shells(spark: SparkSession, binning, edges: list[float]) -> DataFrame:
    """(shell, lo, hi, center); as many rows as shells."""
    rows = [(n + 1, float(edges[n]), float(edges[n + 1]), float(c)) for n, c in enumerate(shell_centers(binning, edges))]
    return spark.createDataFrame(rows, "shell int, lo double, hi double, center double").coalesce(1)
