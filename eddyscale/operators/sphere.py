"""Spherical fields: coefficients by degree and order, and their way to the diagnostics.

Points on rings go through an FFT of each ring, a shuffle by order, and sums of associated Legendre
functions over the rings, an order at a time.  Equiangular rings stand at (j + 1/2) pi / n; their
functions of the colatitude, which continue evenly or oddly past the poles by the order's parity, are
made twice as dense by Fourier series first, so that quadrature is exact up to degree n - 1.  Points
anywhere are summed against all harmonics, with weights of their own or equal ones; with a tolerance
they go to a Fourier series over both angles first (``scattered``), and each order's series in the
colatitude meets the Legendre functions on the doubled sphere, so that no point meets a harmonic.

Coefficients are modes of a grid of lmax + 1 by 2 lmax + 1 whose wavenumbers are given: degree along
the first axis, and along the second the place m + l, or the order itself (``by_order``), as a
Fourier index.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.types import Grid

#: Recurrences start from sin^m, which leaves the doubles beyond about this degree.
MOST_DEGREE = 1500


def harmonics(lmax: int, theta: np.ndarray, phi: np.ndarray) -> np.ndarray:
    """Orthonormal complex Y_lm at colatitude and longitude: rows l*l + l + m, by stable recurrences."""
    x, s = np.cos(theta), np.sin(theta)
    out = np.zeros(((lmax + 1) ** 2, len(theta)), complex)
    diagonal = np.full(len(theta), math.sqrt(1 / (4 * math.pi)))
    for m in range(lmax + 1):
        if m:
            diagonal = -math.sqrt((2 * m + 1) / (2 * m)) * s * diagonal
        before, now = np.zeros(len(theta)), diagonal
        for deg in range(m, lmax + 1):
            if deg > m:
                a = math.sqrt((4 * deg * deg - 1) / (deg * deg - m * m))
                b = math.sqrt(((deg - 1) ** 2 - m * m) / (4 * (deg - 1) ** 2 - 1)) if deg - 1 > m else 0.0
                before, now = now, a * (x * now - b * before)
            wave = now * np.exp(1j * m * phi)
            out[deg * deg + deg + m] = wave
            if m:
                out[deg * deg + deg - m] = (-1) ** m * wave.conj()
    return out


def spherical_analysis(points: DataFrame, lmax: int, tolerance: float | None = None, components: list[int] | None = None) -> DataFrame:
    """(field_id, l, m, c, re, im) of points (field_id, theta, phi, c, value, weight): sums of weight f conj(Y_lm).

    Weights are quadrature weights that sum to 4 pi; without a column ``weight`` every point of
    a field counts alike, as scattered points do.  Fields are summed in parts of a few thousand
    points, then the parts; with a ``tolerance``, in time linear in the points.
    """
    if "weight" not in points.columns:
        n = points.groupBy("field_id", "c").agg(F.count("*").alias("__n"))
        points = points.join(n, ["field_id", "c"]).withColumn("weight", 4 * math.pi / F.col("__n"))

    if tolerance is not None:
        return _by_series(points, lmax, tolerance, components)

    def run(batches):
        for pdf in batches:
            for (field, c), own in pdf.groupby(["field_id", "c"]):
                y = harmonics(lmax, own["theta"].to_numpy(), own["phi"].to_numpy())
                a = y.conj() @ (own["value"].to_numpy() * own["weight"].to_numpy())
                lm = [(deg, m) for deg in range(lmax + 1) for m in range(-deg, deg + 1)]
                yield pd.DataFrame({"field_id": field, "l": [x for x, _ in lm], "m": [x for _, x in lm], "c": c, "re": a.real, "im": a.imag})

    parts = points.select("field_id", "theta", "phi", "c", "value", "weight").mapInPandas(run, "field_id string, l int, m int, c int, re double, im double")
    return parts.groupBy("field_id", "l", "m", "c").agg(F.sum("re").alias("re"), F.sum("im").alias("im"))


def _by_series(points: DataFrame, lmax: int, tolerance: float, components: list[int] | None) -> DataFrame:
    """The same by a Fourier series over both angles, and order by order."""
    from . import scattered, transforms

    if lmax > MOST_DEGREE:
        raise ValueError(f"degrees up to {MOST_DEGREE}")
    components, n = components or transforms._numbers(points), 2 * lmax + 1
    rows = points.select("field_id", F.col("theta").alias("x0"), F.col("phi").alias("x1"), "c", (F.col("value") * F.col("weight")).alias("value"))
    series = scattered.forward(rows, Grid((n, n)), components, tolerance)
    parts, size = min(lmax + 1, max(1, (lmax + 1) // 8)), 2 * n  # points of the whole circle, twice the series' length
    theta = (np.arange(n) + 0.5) * math.pi / n
    field = points.schema["field_id"].dataType.simpleString()
    number = {c: i for i, c in enumerate(components)}

    def summed(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        orders = list(range(part, lmax + 1, parts))
        f = np.zeros((len(components), len(orders), n), complex)
        at = (np.array([number[c] for c in table.column("c").to_pylist()]), (table.column("i1").to_numpy() - part) // parts, table.column("i0").to_numpy())
        f[at] = table.column("re").to_numpy() + 1j * table.column("im").to_numpy()
        k = np.where(np.arange(n) <= lmax, np.arange(n), np.arange(n) - n)
        wide = np.zeros((*f.shape[:2], size), complex)
        wide[..., k % size] = f * np.exp(1j * k * math.pi / size)  # at half steps
        whole = np.fft.ifft(wide, axis=-1)  # the sum over the series, over the number of points
        made = []
        for i, order in enumerate(orders):
            # the functions go on past the poles evenly or oddly
            own = whole[:, i, :n] + (-1 if order % 2 else 1) * whole[:, i, :n - 1:-1]
            for deg, p in legendre(lmax, order, theta):
                made += _both(deg, order, own @ p, components)
        return _coefficients(table, made)

    low = series.where(F.col("i1") <= lmax).withColumn("part", (F.col("i1") % parts).cast("int"))
    return low.groupBy("field_id", "part").applyInArrow(summed, f"field_id {field}, l int, m int, c int, re double, im double")


def _both(deg: int, order: int, a: np.ndarray, components: list[int]) -> list[tuple]:
    """Rows of an order and of its negative, of a real field."""
    out, sign = [], -1 if order % 2 else 1
    for c, z in zip(components, a, strict=True):
        out.append((deg, order, c, z.real, z.imag))
        if order:
            out.append((deg, -order, c, sign * z.real, -sign * z.imag))
    return out


def _coefficients(table: pa.Table, rows: list[tuple]) -> pa.Table:
    columns = [pa.array(x, k) for x, k in zip(zip(*rows, strict=True), [pa.int32()] * 3 + [pa.float64()] * 2, strict=True)]
    return pa.table([table.column("field_id").combine_chunks().take(pa.array([0] * len(rows), pa.int64())), *columns], names=["field_id", "l", "m", "c", "re", "im"])


def gauss_grid(lmax: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Colatitude, longitude and weight of a grid that analyses degree ``lmax`` exactly."""
    x, w = np.polynomial.legendre.leggauss(lmax + 1)
    n = 2 * lmax + 2
    theta, phi = np.meshgrid(np.arccos(x), np.arange(n) * 2 * math.pi / n, indexing="ij")
    return theta.ravel(), phi.ravel(), np.repeat(w * 2 * math.pi / n, n)


def spherical_spectrum(coefficients: DataFrame) -> DataFrame:
    """Energy by degree."""
    return coefficients.groupBy("field_id", "l").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"))


# --- rings --------------------------------------------------------------------------------------


def fejer(n: int) -> np.ndarray:
    """Weights of n equiangular rings, for integrals over the cosine."""
    theta, k = (np.arange(n) + 0.5) * math.pi / n, np.arange(1, n // 2 + 1)
    return 2 / n * (1 - 2 * (np.cos(2 * np.outer(theta, k)) / (4 * k**2 - 1)).sum(1))


def rings(kind: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Colatitudes and weights (for integrals over the cosine) of ``n`` rings."""
    if kind == "gauss":
        x, w = np.polynomial.legendre.leggauss(n)
        return np.arccos(x), w
    if kind == "equiangular":
        return (np.arange(n) + 0.5) * math.pi / n, fejer(n)
    raise ValueError(f"rings: {kind!r}")


def denser(f: np.ndarray, odd: bool) -> np.ndarray:
    """(.., ring) on twice as many equiangular rings, by the Fourier series of the field continued past the poles."""
    n = f.shape[-1]
    whole = np.concatenate([f, (-1 if odd else 1) * f[..., ::-1]], axis=-1)
    k = np.arange(-n, n + 1)
    shift = lambda size: np.exp(-1j * k * math.pi / (2 * size))  # noqa: E731  half a ring
    series = np.fft.fft(whole, axis=-1)[..., k % (2 * n)] / (2 * n) * shift(n)
    series[..., [0, -1]] /= 2  # the two ends are one place of the transform
    wide = np.zeros((*f.shape[:-1], 4 * n), complex)
    wide[..., k % (4 * n)] = series * shift(2 * n).conj()
    return np.fft.ifft(wide, axis=-1)[..., : 2 * n] * (4 * n)


def legendre(lmax: int, m: int, theta: np.ndarray):
    """(degree, values) of the orthonormal associated Legendre functions of order m, from degree m up."""
    x, s = np.cos(theta), np.sin(theta)
    now = np.full(len(theta), math.sqrt(1 / (4 * math.pi)))
    for j in range(1, m + 1):
        now = -math.sqrt((2 * j + 1) / (2 * j)) * s * now
    before = np.zeros(len(theta))
    for deg in range(m, lmax + 1):
        if deg > m:
            a = math.sqrt((4 * deg * deg - 1) / (deg * deg - m * m))
            b = math.sqrt(((deg - 1) ** 2 - m * m) / (4 * (deg - 1) ** 2 - 1)) if deg - 1 > m else 0.0
            before, now = now, a * (x * now - b * before)
        yield deg, now


def ring_analysis(points: DataFrame, nrings: int, nphi: int, lmax: int, m: int, kind: str = "equiangular", parts: int | None = None) -> DataFrame:
    """(field_id, l, m, c, re, im) of points (field_id, i0: ring, i1: longitude from 0, c, value) on a whole grid.

    Rings must suffice: ``nrings`` over ``lmax``, and 2 lmax + 1 longitudes.  Orders are dealt to ``parts``
    tasks in turn, since low ones have more degrees.
    """
    if lmax >= nrings or nphi < 2 * lmax + 1:
        raise ValueError(f"{nrings} rings of {nphi} points don't tell degrees up to {lmax}")
    if lmax > MOST_DEGREE:
        raise ValueError(f"degrees up to {MOST_DEGREE}")
    parts = min(lmax + 1, parts or max(1, (lmax + 1) // 8))
    theta, weight = rings(kind, 2 * nrings if kind == "equiangular" else nrings)
    field = points.schema["field_id"].dataType.simpleString()

    def turned(table: pa.Table) -> pa.Table:
        a = np.zeros((m, nphi))
        np.add.at(a, (table.column("c").to_numpy(), table.column("i1").to_numpy()), table.column("value").to_numpy())
        z = np.fft.fft(a, axis=1)[:, : lmax + 1] * (2 * math.pi / nphi)
        own = table.column("field_id").combine_chunks().take(pa.array([0] * parts, pa.int64()))
        return pa.table({"field_id": own, "part": pa.array(range(parts), pa.int32()), "i0": pa.array([table.column("i0")[0].as_py()] * parts, pa.int32()), "z": pa.array([np.ascontiguousarray(z[:, p::parts]).tobytes() for p in range(parts)], pa.binary())})

    def summed(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        orders = range(part, lmax + 1, parts)
        f = np.zeros((m, len(orders), nrings), complex)
        for ring, z in zip(table.column("i0").to_pylist(), table.column("z"), strict=True):
            f[:, :, ring] = np.frombuffer(z.as_buffer(), complex).reshape(m, len(orders))
        out = []
        for i, order in enumerate(orders):
            own = (denser(f[:, i], order % 2 == 1) if kind == "equiangular" else f[:, i]) * weight
            for deg, p in legendre(lmax, order, theta):
                out += _both(deg, order, own @ p, list(range(m)))
        return _coefficients(table, out)

    rows = points.where(F.col("c") < m).select("field_id", F.col("i0").cast("int").alias("i0"), F.col("i1").cast("int").alias("i1"), F.col("c").cast("int").alias("c"), F.col("value").cast("double").alias("value"))
    orders = rows.groupBy("field_id", "i0").applyInArrow(turned, f"field_id {field}, part int, i0 int, z binary")
    return orders.groupBy("field_id", "part").applyInArrow(summed, f"field_id {field}, l int, m int, c int, re double, im double")


# --- coefficients as modes ----------------------------------------------------------------------


def coefficient_grid(lmax: int, by_order: bool = False) -> Grid:
    """The grid of coefficients: degrees along the first axis; along the second their places or orders."""
    degrees = tuple(float(x) for x in range(lmax + 1))
    return Grid((lmax + 1, 2 * lmax + 1), waves=(degrees, None if by_order else tuple(float(x) for x in range(2 * lmax + 1))))


def as_modes(coefficients: DataFrame, lmax: int, by_order: bool = False) -> DataFrame:
    """Modes (field_id, i0, i1, c, re, im) of coefficients (field_id, l, m, c, re, im)."""
    second = F.pmod("m", F.lit(2 * lmax + 1)) if by_order else F.col("m") + F.col("l")
    return coefficients.where(F.col("l") <= lmax).select("field_id", F.col("l").cast("int").alias("i0"), second.cast("int").alias("i1"), "c", "re", "im")
