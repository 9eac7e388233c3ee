"""Fourier transforms between points and modes, and filtering.

A gridded transform goes axis by axis: each row meets the indices of one axis, an exploded literal
range, and products are summed with map-side combining, so a grid of n^d points costs d n rows a
point, not n^d.  Grids of more than ``LARGE`` points go through numpy, whole fields in stacks.
Scattered points are summed a batch at a time in numpy, and blocks of points meet blocks of modes:
exact, and as dear as points times modes.  With a ``tolerance`` they go through ``scattered``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import FFT, Grid, ShellMagnitude, engine
from . import modes as M
from . import scattered, stack

#: Points of a grid beyond which method="auto" transforms in numpy.
LARGE = 4096


def _by_fft(grid: Grid, method: str) -> bool:
    return grid.size > LARGE if method == "auto" else engine(method) == FFT


def _axes(rows: DataFrame, grid: Grid, sign: int) -> DataFrame:
    """Sums of (re + i im) exp(sign i angle) over x0.., one axis after another, by i0.. ."""
    for d, n in enumerate(grid.ns):
        rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(f"i{d}"))
        angle = F.pmod(F.col(f"i{d}") * F.col(f"x{d}"), F.lit(n)) * F.lit(2 * math.pi / n)
        re, im, cos, sin = F.col("re"), F.col("im"), F.cos(angle), sign * F.sin(angle)
        own = ["field_id", "c", *(f"i{e}" for e in range(d + 1)), *(f"x{e}" for e in range(d + 1, grid.nd))]
        rows = rows.groupBy(*own).agg(F.sum(re * cos - im * sin).alias("re"), F.sum(im * cos + re * sin).alias("im"))
    return rows


def _fft(df: DataFrame, grid: Grid, forward: bool, m: int | None) -> DataFrame:
    """Packed transforms of long or packed fields; the values of packed points are their ``re``."""
    if not stack.is_packed(df):
        if forward:
            df = df.withColumnRenamed("value", "re").withColumn("im", F.lit(0.0))
        df = df if m else M.once(df)
        df = stack.pack(df, grid, m or M.components(df))
    axes = tuple(range(-grid.nd, 0))

    def run(f):
        a = np.fft.fftn(f, axes=axes) / grid.size if forward else np.fft.ifftn(f, axes=axes).real * grid.size
        return {"re": a.real, "im": a.imag}

    return stack.mapped(stack.together({"f": df}), grid, ["f"], [], "re array<double>, im array<double>", run, width=2)


def forward(points: DataFrame, grid: Grid, method: str = "auto", m: int | None = None) -> DataFrame:
    """Points on the grid (field_id, i0.., c, value) to modes: the sum times 1/Np. Packed points give packed modes."""
    if stack.is_packed(points):
        return _fft(points, grid, True, m)
    if _by_fft(grid, method):
        return stack.unpack(_fft(points, grid, True, m), grid)
    named = points.select("field_id", "c", (F.col("value") / grid.size).alias("re"), F.lit(0.0).alias("im"), *(F.col(f"i{d}").alias(f"x{d}") for d in range(grid.nd)))
    return _axes(named, grid, -1).select(*M.place(grid), "c", "re", "im")


def inverse(modes: DataFrame, grid: Grid, method: str = "auto", m: int | None = None) -> DataFrame:
    """Modes to points, real part: the plain sum, so that ``inverse(forward(x)) == x``."""
    if stack.is_packed(modes):
        return _fft(modes, grid, False, m)
    if _by_fft(grid, method):
        return stack.unpack(_fft(modes, grid, False, m), grid).withColumnRenamed("re", "value").drop("im")
    named = modes.select("field_id", "c", "re", "im", *(F.col(f"i{d}").alias(f"x{d}") for d in range(grid.nd)))
    return _axes(named, grid, 1).select(*M.place(grid), "c", F.col("re").alias("value"))


def apply_filter(modes: DataFrame, grid: Grid, kind, scale: float, geometry: ShellMagnitude = ShellMagnitude()) -> DataFrame:  # noqa: B008
    """Every mode times the filter's response at its wavenumber."""
    g = spectral.filter_response(kind, spectral.magnitude(grid, geometry), scale)
    return modes.withColumns({"re": F.col("re") * g, "im": F.col("im") * g})


def rescaled(points: DataFrame, nd: int) -> DataFrame:
    """Coordinates x0.. to [-pi, pi) by each field's own range; a range of zero gives 0."""
    ranges = points.groupBy("field_id").agg(*(f(f"x{d}").alias(f"{n}{d}") for d in range(nd) for f, n in ((F.min, "lo"), (F.max, "hi"))))
    joined = points.join(ranges, "field_id")
    made = {f"x{d}": F.when(F.col(f"hi{d}") > F.col(f"lo{d}"), (F.col(f"x{d}") - F.col(f"lo{d}")) / (F.col(f"hi{d}") - F.col(f"lo{d}")) * (2 * math.pi) - math.pi).otherwise(0.0) for d in range(nd)}
    return joined.withColumns(made).select(*points.columns)


def _integer_modes(grid: Grid) -> np.ndarray:
    """(mode, axis): integer wavenumbers of all modes, in row order."""
    return np.stack([k.ravel() for k in np.meshgrid(*(spectral.axis(n) for n in grid.ns), indexing="ij")], 1)


def scattered_forward(points: DataFrame, grid: Grid, tolerance: float | None = None, components: list[int] | None = None) -> DataFrame:
    """Type 1: modes of scattered points on [-pi, pi), (1/N) sum f e^{-ikx}. One to three dimensions.

    Every task sums its points by field; what is shuffled is sums.  ``components`` are looked up
    if a ``tolerance`` is given without them.
    """
    if not 1 <= grid.nd <= 3:
        raise ValueError("one to three dimensions")
    count = points.groupBy("field_id", "c").agg(F.count("*").alias("n"))
    if tolerance is not None:
        sums = scattered.forward(points, grid, components or _numbers(points), tolerance)
        return sums.join(count, ["field_id", "c"]).select(*M.place(grid), "c", (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))
    k, index = _integer_modes(grid), np.indices(grid.ns).reshape(grid.nd, -1).astype(np.int32)
    xs = [f"x{d}" for d in range(grid.nd)]

    def run(batches):
        for pdf in batches:
            for (field, c), own in pdf.groupby(["field_id", "c"]):
                total = np.zeros(len(k), complex)
                for at in range(0, len(own), 1024):
                    part = own.iloc[at : at + 1024]
                    total += np.exp(-1j * (k @ part[xs].to_numpy(float).T)) @ part["value"].to_numpy(float)
                yield pd.DataFrame({"field_id": field, **{f"i{d}": index[d] for d in range(grid.nd)}, "c": np.int32(c), "re": total.real, "im": total.imag})

    schema = ", ".join(["field_id string", *(f"i{d} int" for d in range(grid.nd)), "c int", "re double", "im double"])
    parts = points.select("field_id", "c", F.col("value").cast("double").alias("value"), *xs).mapInPandas(run, schema)
    sums = parts.groupBy(*M.place(grid), "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))
    return sums.join(count, ["field_id", "c"]).select(*M.place(grid), "c", (F.col("re") / F.col("n")).alias("re"), (F.col("im") / F.col("n")).alias("im"))


def _numbers(rows: DataFrame) -> list[int]:
    """The components that there are, a few."""
    return sorted(r["c"] for r in rows.select("c").distinct().collect())


def scattered_inverse(modes: DataFrame, places: DataFrame, grid: Grid, block: int = 4096, tolerance: float | None = None, components: list[int] | None = None) -> DataFrame:
    """Type 2: the modes' sum e^{+ikx} at scattered places (field_id, point, x0..): field_id, point, c, value.

    A field's places are cut into blocks of about ``block``; its modes go to each of them.
    """
    if tolerance is not None:
        return scattered.inverse(modes, places, grid, components or _numbers(modes), tolerance)
    most = places.groupBy("field_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 1
    blocks = -(-most // block)
    own = places.withColumn("part", F.pmod(F.xxhash64("point"), F.lit(blocks)).cast("int"))
    every = modes.select("field_id", *(f"i{d}" for d in range(grid.nd)), "c", "re", "im", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("part"))
    axes, xs = [spectral.axis(n) for n in grid.ns], [f"x{d}" for d in range(grid.nd)]

    def run(some: pa.Table, at: pa.Table) -> pa.Table:
        c, which = np.unique(some.column("c").to_numpy(), return_inverse=True)
        z = some.column("re").to_numpy() + 1j * some.column("im").to_numpy()
        spread = np.zeros((len(z), len(c)), complex)
        spread[np.arange(len(z)), which] = z
        k = np.stack([axis[some.column(f"i{d}").to_numpy()] for d, axis in enumerate(axes)], 1)
        x = np.stack([at.column(n).to_numpy() for n in xs], 1)
        value = [(np.exp(1j * (x[i : i + 512] @ k.T)) @ spread).real for i in range(0, len(x), 512)]
        value = np.concatenate(value) if value else np.zeros((0, len(c)))
        take = pa.array(np.repeat(np.arange(len(x)), len(c)))
        return pa.table({"field_id": at.column("field_id").take(take), "point": at.column("point").take(take), "c": pa.array(np.tile(c, len(x)).astype(np.int32)), "value": value.ravel()})

    kind = places.schema["point"].dataType.simpleString()
    return every.groupBy("field_id", "part").cogroup(own.groupBy("field_id", "part")).applyInArrow(run, f"field_id string, point {kind}, c int, value double")
