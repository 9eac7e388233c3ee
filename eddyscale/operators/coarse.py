"""Coarse-graining energy flux: filtered stress against filtered strain."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import Grid, NoDecomposition
from . import modes as M
from . import pencil, stack
from . import transforms as T
from .decompose import decompose


def _columns(nd: int) -> str:
    ij = [f"{i}{j}" for i in range(nd) for j in range(nd)]
    return ", ".join([*(f"tau{x} double" for x in ij), *(f"s{x} double" for x in ij)])


def _stress_flux(nd: int, bar: list, square: dict, slope: list) -> tuple:
    """Flux, and stress and strain by name, of filtered components, products and gradients (arrays)."""
    total, tau, strain = 0.0, {}, {}
    for i in range(nd):
        for j in range(nd):
            tau[f"tau{i}{j}"] = square[min(i, j), max(i, j)] - bar[i] * bar[j]
            strain[f"s{i}{j}"] = (slope[i][j] + slope[j][i]) / 2
            total = total - tau[f"tau{i}{j}"] * strain[f"s{i}{j}"]
    return total, tau | strain


def flux_map(points: DataFrame, grid: Grid, kind, scale: float, decomposition=NoDecomposition(), keep: bool = False, any_dimension: bool = False) -> DataFrame:  # noqa: B008
    """field_id, [component], i0.., flux (and, with ``keep``, tau_ij and s_ij) of a velocity on the grid.

    Points are long, or packed with their values as ``re``.  Stacks of fields go through the same
    transforms; a field that is too large for a task goes through ``masked_flux_map``.
    """
    if grid.nd != 2 and not any_dimension:
        raise ValueError("coarse graining of gridded fields is two-dimensional")
    nd = grid.nd
    split = not isinstance(decomposition, NoDecomposition)
    if split:
        parts = decompose(T.forward(points, grid, "fft"), grid, decomposition, nd)
        # a part of a field is a field of its own meanwhile
        points = T.inverse(parts.withColumn("field_id", F.to_json(F.struct("field_id", "component"))).drop("component"), grid, "fft", m=nd)
    if not stack.is_packed(points):
        points = stack.pack(points.withColumnRenamed("value", "re").withColumn("im", F.lit(0.0)), grid, nd)
    axes = tuple(range(-nd, 0))
    response = spectral.filter_array(kind, spectral.magnitude_array(grid), scale)
    k = np.meshgrid(*spectral.axes(grid), indexing="ij")

    def run(u):
        u, places = u[:, :nd].real, u.shape[2:]
        pairs = [(i, j) for i in range(nd) for j in range(i, nd)]
        both = np.concatenate([u, np.stack([u[:, i] * u[:, j] for i, j in pairs], 1)], axis=1)
        modes = np.fft.fftn(both, axes=axes) * response
        smooth = np.fft.ifftn(modes, axes=axes).real
        slope = [[np.fft.ifftn(1j * k[j] * modes[:, i], axes=axes).real for j in range(nd)] for i in range(nd)]
        total, more = _stress_flux(nd, [smooth[:, i] for i in range(nd)], {p: smooth[:, nd + n] for n, p in enumerate(pairs)}, slope)
        index = np.indices(places).reshape(nd, -1).astype(np.int32)
        flat = lambda a: a.reshape(len(u), -1)
        return {f"i{d}": stack.constant(index[d], len(u)) for d in range(nd)} | {"flux": flat(total)} | ({n: flat(x) for n, x in more.items()} if keep else {})

    made = ", ".join([*(f"i{d} int" for d in range(nd)), "flux double", *([_columns(nd)] if keep else [])])
    got = stack.mapped(stack.together({"f": points}), grid, ["f"], [], made, run, width=nd * nd + 4)
    if split:
        of = F.from_json("field_id", "field_id string, component string")
        got = got.withColumn("of", of).select(F.col("of.field_id").alias("field_id"), F.col("of.component").alias("component"), *(c for c in got.columns if c != "field_id"))
    return got


def masked_flux_map(points: DataFrame, grid: Grid, kind, scale: float, keep: bool = False, parts: int | tuple[int, ...] | None = None, least: float = 1e-12) -> DataFrame:
    """field_id, i0.., wet, flux (and, with ``keep``, tau_ij and s_ij) of long points with a column ``wet``; without it all are wet.

    A filtered quantity is the filter's mean over wet cells: that of the quantity, dry cells counting
    nothing, over that of the mask; its gradient is the quotient's.  Without a dry cell this is
    ``flux_map``.  Cells that are dry, or where the filtered mask isn't over ``least``, get 0.

    The field is cut into blocks (``pencil``): it goes to modes an axis at a time, is filtered in the last
    axis' pencils, and comes back; gradients are made while their axis is spectral.  That is a shuffle
    an axis and direction, less one, and a task holds a pencil.
    """
    nd = grid.nd
    pairs = [(i, j) for i in range(nd) for j in range(i, nd)]
    cut = pencil.cut_of(grid, (nd + 1) ** 2 + len(pairs), parts)
    masked = "wet" in points.columns
    own = points.where(F.col("c") < nd).select("field_id", *M.place(grid)[1:], "c", "value")
    if masked:
        wet = points.where("c = 0").select("field_id", *M.place(grid)[1:], F.lit(nd).alias("c"), F.coalesce(F.col("wet"), F.lit(False)).cast("double").alias("value"))
        own = own.unionByName(wet)
    k = spectral.axes(grid)

    def products(x):
        w = np.minimum(x[nd].real, 1.0) if masked else np.ones(x.shape[1:])
        u = [w * x[i].real for i in range(nd)]
        # u_i u_j of a wet cell, and the mask itself once more for the end
        return np.stack([w, *u, *(u[i] * u[j] for i, j in pairs)])

    def back(x, d):
        slope = x[: nd + 1] * (1j * k[d]).reshape([-1 if e == d + 1 else 1 for e in range(nd + 1)])
        return np.fft.ifft(np.concatenate([x, slope]), axis=d + 1)

    def forward(x, where, d):
        x = np.fft.fft(products(x) if d == 0 else x, axis=d + 1)
        if d < nd - 1:
            return x
        kappa = np.sqrt(sum(a**2 for a in np.meshgrid(*(a[w] for a, w in zip(k, where, strict=True)), indexing="ij")))
        x = back(x * spectral.filter_array(kind, kappa, scale), d)
        return finished(x) if d == 0 else x

    def finished(x):
        x = x.real
        w, a, q = x[0], x[1 : nd + 1], x[nd + 1 : nd + 1 + len(pairs)]
        # gradients came in the order last axis first
        slopes = {d: x[1 + nd + len(pairs) + n * (nd + 1) :][: nd + 1] for n, d in enumerate(range(nd - 1, -1, -1))}
        there = w > least
        safe = np.where(there, w, 1.0)
        bar = [one / safe for one in a]
        slope = [[(slopes[j][1 + i] - bar[i] * slopes[j][0]) / safe for j in range(nd)] for i in range(nd)]
        total, more = _stress_flux(nd, bar, {p: one / safe for p, one in zip(pairs, q, strict=True)}, slope)
        return np.stack([np.where(there, one, 0.0) for one in (total, *(more.values() if keep else ()))]).astype(complex)

    blocks = pencil.blocks(own, grid, nd + masked, cut, ("value",))
    rows = blocks
    for d in range(nd):
        rows = pencil.along(rows, cut, grid.ns, d, lambda x, w, d=d: forward(x, w, d), grid.ns[d])
    for d in range(nd - 2, -1, -1):
        rows = pencil.along(rows, cut, grid.ns, d, lambda x, _, d=d: finished(back(x, d)) if d == 0 else back(x, d), grid.ns[d])
    names = ["flux", *([c.split()[0] for c in _columns(nd).split(", ")] if keep else [])]
    got = pencil.columns(rows, grid, cut, names)
    if not masked:
        return got.withColumn("wet", F.lit(True))
    inside = points.where("c = 0").groupBy(*M.place(grid)).agg(F.bool_or(F.coalesce("wet", F.lit(False))).alias("wet"))
    got = got.join(inside, M.place(grid), "left").withColumn("wet", F.coalesce("wet", F.lit(False)))
    return got.withColumns({n: F.when(F.col("wet"), F.col(n)).otherwise(0.0) for n in names})


def mean_flux(fluxes: DataFrame, keys: tuple[str, ...] = ("field_id",), wet: str | None = None) -> DataFrame:
    """The mean over all points, or over wet ones; without any wet point, 0."""
    if wet is None:
        return fluxes.groupBy(*keys).agg(F.avg("flux").alias("mean_flux"))
    inside = F.coalesce(F.col(wet), F.lit(False))
    return fluxes.groupBy(*keys).agg((F.coalesce(F.sum(F.when(inside, F.col("flux"))), F.lit(0.0)) / F.greatest(F.lit(1), F.sum(inside.cast("int")))).alias("mean_flux"))


def scattered_flux(points: DataFrame, grid: Grid, kind, scale: float, keep: bool = False, tolerance: float | None = None) -> DataFrame:
    """field_id, point, flux of a velocity at scattered points (field_id, point, x0.., c, value).

    With a ``tolerance`` transforms are as dear as points and modes, not as their product.

    Coordinates are first scaled to the period.  Fluxes of each point are summed over the stress
    components i <= j, those off the diagonal twice.
    """
    nd = grid.nd
    if not 1 <= nd <= 3:
        raise ValueError("one to three dimensions")
    points = T.rescaled(points.where(F.col("c") < nd), nd)
    xs = [f"x{d}" for d in range(nd)]
    wide = points.groupBy("field_id", "point", *xs).agg(*(F.sum(F.when(F.col("c") == c, F.col("value")).otherwise(0.0)).alias(f"v{c}") for c in range(nd)))
    pairs = [(i, j) for i in range(nd) for j in range(i, nd)]
    terms = [F.struct(F.lit(c).alias("c"), F.col(f"v{c}").alias("value")) for c in range(nd)]
    terms += [F.struct(F.lit(nd + n).alias("c"), (F.col(f"v{i}") * F.col(f"v{j}")).alias("value")) for n, (i, j) in enumerate(pairs)]
    long = wide.select("field_id", "point", *xs, F.explode(F.array(*terms)).alias("t")).select("field_id", "point", *xs, "t.c", "t.value")
    smooth = T.apply_filter(T.scattered_forward(long, grid, tolerance, list(range(nd + len(pairs)))), grid, kind, scale)
    k = spectral.wavenumbers(grid)
    # the gradient j of component c is row 100 + 10 c + j
    rows = [F.struct(F.col("c").alias("c"), F.col("re").alias("re"), F.col("im").alias("im"))]
    slopes = [F.struct((100 + 10 * F.col("c") + j).alias("c"), (-k[j] * F.col("im")).alias("re"), (k[j] * F.col("re")).alias("im")) for j in range(nd)]
    spread = F.explode(F.when(F.col("c") < nd, F.array(*rows, *slopes)).otherwise(F.array(*rows)))
    every = smooth.select(*M.place(grid), spread.alias("t")).select(*M.place(grid), "t.c", "t.re", "t.im")
    names = {c: f"b{c}" for c in range(nd)} | {nd + n: f"q{i}{j}" for n, (i, j) in enumerate(pairs)} | {100 + 10 * c + j: f"d{c}{j}" for c in range(nd) for j in range(nd)}
    values = T.scattered_inverse(every, wide.select("field_id", "point", *xs), grid, tolerance=tolerance, components=sorted(names))
    flat = values.groupBy("field_id", "point").agg(*(F.sum(F.when(F.col("c") == c, F.col("value")).otherwise(0.0)).alias(n) for c, n in names.items()))
    tau = {(i, j): F.col(f"q{i}{j}") - F.col(f"b{i}") * F.col(f"b{j}") for i, j in pairs}
    strain = {(i, j): (F.col(f"d{i}{j}") + F.col(f"d{j}{i}")) / 2 for i, j in pairs}
    flux = -spectral.add([(1 if i == j else 2) * tau[i, j] * strain[i, j] for i, j in pairs])
    more = [x.alias(f"{n}{i}{j}") for i, j in pairs for n, x in (("tau", tau[i, j]), ("s", strain[i, j]))] if keep else []
    return flat.select("field_id", "point", flux.alias("flux"), *more)
