"""Spectral flux, shell-to-shell, band-to-band, mode-to-mode and component-resolved transfer.

All are one nonlinear term with different givers (which advected modes) and receivers (which
key t(k) is summed by).  ``transfer`` is what a receiver loses; flux is its running sum.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import FFT, Grid, KineticEnergy, NoDecomposition, OrszagTwoThirds, PassiveScalar, ShellMagnitude, SmoothBands, engine
from . import density as D
from . import modes as M
from . import nonlinear as N
from . import shells as S
from . import stack
from .decompose import decompose

_OT, _KE, _ISO = OrszagTwoThirds(), KineticEnergy(), ShellMagnitude()


class Transfer(NamedTuple):
    """matrix (field_id, n, m, transfer); net (field_id, n, lo, hi, center, net); error (field_id, max_antisymmetry_error)."""

    matrix: DataFrame
    net: DataFrame
    error: DataFrame


class ModeTransfer(NamedTuple):
    """pairs (field_id, k.., p.., s); net (field_id, k.., net)."""

    pairs: DataFrame
    net: DataFrame


def _fields(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.select(*keys).distinct()


def _filled(sums: DataFrame, of: DataFrame, keys: list[str], edges: list[float], binning) -> DataFrame:
    """Every shell of every key; empty ones are 0."""
    centers = S.shell_centers(binning, edges)
    rows = F.explode(F.array(*(F.struct(F.lit(n + 1).alias("shell"), F.lit(float(c)).alias("k_shell")) for n, c in enumerate(centers))))
    every = of.select(*keys).distinct().select(*keys, rows.alias("s")).select(*keys, "s.shell", "s.k_shell")
    return every.join(sums, [*keys, "shell"], "left").withColumn("transfer", F.coalesce("transfer", F.lit(0.0)))


def _flux(filled: DataFrame, keys: list[str]) -> DataFrame:
    run = Window.partitionBy(*keys).orderBy("shell").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*keys, "shell", "k_shell", "transfer", F.sum("transfer").over(run).alias("flux"))


def spectral_flux(f: DataFrame, grid: Grid, u: DataFrame | None = None, binning=None, dealiasing=_OT, invariant=_KE, decomposition=NoDecomposition(), geometry: ShellMagnitude = _ISO, method: str = "sql", m: int | None = None) -> DataFrame:  # noqa: B008
    """field_id, [component], shell, k_shell, transfer, flux. A decomposition replaces the carrier only.

    Fields are long modes, or packed ones for ``method="fft"``.
    """
    D.check(invariant, grid)
    f, u, m = M.read_often(f, u, m, grid)
    binning, edges = S.edges_of(grid, binning, geometry)
    split = not isinstance(decomposition, NoDecomposition)
    keys = ["field_id", "component"] if split else ["field_id"]
    if engine(method) == FFT:
        if not split:
            return _fused_flux(u, f, grid, m, dealiasing, invariant, geometry, binning, edges)
        if stack.is_packed(f):
            f = M.once(stack.unpack(f, grid))
        term = M.widen(N.nonlinear_term(f, grid, u, dealiasing, FFT, m=m), grid, m, [])
    else:
        term = N.wide_term(u, f, grid, m, dealiasing)
    carrier = decompose(f, grid, decomposition, m) if split else f
    t = D.of_wide(M.widen(carrier, grid, m, keys[1:]), term, grid, m, invariant, keys[1:])
    shell = S.shell_of(spectral.magnitude(grid, geometry), edges)
    sums = t.withColumn("shell", shell).where("shell > 0").groupBy(*keys, "shell").agg(F.sum("t").alias("transfer"))
    every = f.select("field_id").distinct()
    if split:
        every = every.select("field_id", F.explode(F.array(*map(F.lit, decomposition.parts))).alias("component"))
    return _flux(_filled(sums, every, keys, edges, binning), keys)


def scalar_flux(scalar: DataFrame, velocity: DataFrame, grid: Grid, **options) -> DataFrame:
    return spectral_flux(scalar, grid, u=velocity, invariant=PassiveScalar(), **options)


def partial_fluxes(f: DataFrame, grid: Grid, decomposition, binning=None, dealiasing=_OT, geometry: ShellMagnitude = _ISO, method: str = "sql", m: int | None = None) -> DataFrame:
    """field_id, s_k, s_p, s_q, shell, k_shell, transfer, flux of Re{u_sk* . [(u_sp . grad) u_sq]}."""
    if len(decomposition.parts) < 2:
        raise ValueError("partial fluxes need two named parts at least")
    f, _, m = M.read_often(f, None, m, grid)
    binning, edges = S.edges_of(grid, binning, geometry)
    if stack.is_packed(f):
        f = stack.unpack(f, grid)
    parts = M.once(decompose(f, grid, decomposition, m))
    if engine(method) == FFT:
        return _fused_parts(parts, grid, m, dealiasing, geometry, decomposition.parts, binning, edges)
    name = lambda k: parts.withColumnRenamed("component", k)
    term = N.wide_term(name("s_p"), name("s_q"), grid, m, dealiasing, ["s_p"], ["s_q"])
    keys = ["field_id", "s_k", "s_p", "s_q"]
    t = D.of_wide(M.widen(name("s_k"), grid, m, ["s_k"]), term, grid, m, _KE, keys[1:])
    shell = S.shell_of(spectral.magnitude(grid, geometry), edges)
    sums = t.withColumn("shell", shell).where("shell > 0").groupBy(*keys, "shell").agg(F.sum("t").alias("transfer"))
    names = lambda k: F.explode(F.array(*map(F.lit, decomposition.parts))).alias(k)
    every = f.select("field_id").distinct().select("*", names("s_k")).select("*", names("s_p")).select("*", names("s_q"))
    return _flux(_filled(sums, every, keys, edges, binning), keys)


def total_flux(partial: DataFrame) -> DataFrame:
    """The sum over all channels."""
    return partial.groupBy("field_id", "shell", "k_shell").agg(F.sum("transfer").alias("transfer"), F.sum("flux").alias("flux"))


def helical_partial_fluxes(f: DataFrame, grid: Grid, **options) -> DataFrame:
    from ..plans.types import HelicalDecomposition

    return partial_fluxes(f, grid, HelicalDecomposition(), **options)


def _dense(sums: DataFrame, f: DataFrame, count: int) -> DataFrame:
    """Every cell of every field's matrix; empty ones are 0."""
    one = lambda k: F.explode(F.sequence(F.lit(1), F.lit(count))).alias(k)
    every = _fields(f, ["field_id"]).select("field_id", one("n")).select("field_id", "n", one("m"))
    return every.join(sums, ["field_id", "n", "m"], "left").select("field_id", "n", "m", F.coalesce("transfer", F.lit(0.0)).alias("transfer"))


def _transfer(matrix: DataFrame, lo: list, hi: list, centers: list) -> Transfer:
    """A matrix with its row sums and antisymmetry error."""
    pick = lambda v: F.element_at(F.array(*map(F.lit, v)), F.col("n"))
    net = matrix.groupBy("field_id", "n").agg(F.sum("transfer").alias("net"))
    net = net.select("field_id", "n", pick(lo).alias("lo"), pick(hi).alias("hi"), pick(centers).alias("center"), "net")
    # T[n,m] and T[m,n] meet under one key, without a join
    pairs = matrix.groupBy("field_id", F.least("n", "m").alias("a"), F.greatest("n", "m").alias("b")).agg(F.sum(F.when(F.col("n") == F.col("m"), 2 * F.col("transfer")).otherwise(F.col("transfer"))).alias("both"))
    return Transfer(matrix, net, pairs.groupBy("field_id").agg(F.max(F.abs("both")).alias("max_antisymmetry_error")))


def shell_to_shell(f: DataFrame, grid: Grid, u: DataFrame | None = None, binning=None, dealiasing=_OT, invariant=_KE, geometry: ShellMagnitude = _ISO, method: str = "sql", m: int | None = None) -> Transfer:
    """T[n,m]: the whole velocity advects the field of shell m, received in shell n."""
    D.check(invariant, grid)
    f, u, m = M.read_often(f, u, m, grid)
    binning, edges = S.edges_of(grid, binning, geometry)
    shell = S.shell_of(spectral.magnitude(grid, geometry), edges)
    if engine(method) == FFT:
        matrix = _fused_matrix(u, f, grid, m, dealiasing, invariant, geometry, edges, None)
    else:
        term = N.wide_term(u, f.withColumn("giver", shell).where("giver > 0"), grid, m, dealiasing, f_keys=["giver"])
        t = D.of_wide(M.widen(f, grid, m, []), term, grid, m, invariant, ["giver"])
        sums = t.withColumn("n", shell).where("n > 0").groupBy("field_id", "n", F.col("giver").alias("m")).agg(F.sum("t").alias("transfer"))
        matrix = _dense(sums, f, len(edges) - 1)
    return _transfer(matrix, edges[:-1], edges[1:], S.shell_centers(binning, edges))


def scalar_shell_to_shell(scalar: DataFrame, velocity: DataFrame, grid: Grid, **options) -> Transfer:
    return shell_to_shell(scalar, grid, u=velocity, invariant=PassiveScalar(), **options)


def band_to_band(f: DataFrame, grid: Grid, bands: SmoothBands, u: DataFrame | None = None, dealiasing=_OT, invariant=_KE, geometry: ShellMagnitude = _ISO, method: str = "sql", m: int | None = None) -> Transfer:
    """T[n,m] of overlapping bands: giver and receiver weights."""
    D.check(invariant, grid)
    f, u, m = M.read_often(f, u, m, grid)
    centers = [float(c) for c in bands.centers]
    if engine(method) == FFT:
        matrix = _fused_matrix(u, f, grid, m, dealiasing, invariant, geometry, [], bands)
    else:
        weights = spectral.band_weights(bands, spectral.magnitude(grid, geometry))
        spread = F.posexplode(weights).alias("b", "w")
        given = f.select("*", spread).where("w > 0").select(*M.place(grid), "c", (F.col("re") * F.col("w")).alias("re"), (F.col("im") * F.col("w")).alias("im"), (F.col("b") + 1).alias("giver"))
        term = N.wide_term(u, given, grid, m, dealiasing, f_keys=["giver"])
        t = D.of_wide(M.widen(f, grid, m, []), term, grid, m, invariant, ["giver"])
        sums = t.select("*", spread).groupBy("field_id", (F.col("b") + 1).alias("n"), F.col("giver").alias("m")).agg(F.sum(F.col("t") * F.col("w")).alias("transfer"))
        matrix = _dense(sums, f, len(centers))
    return _transfer(matrix, centers, centers, centers)


def mode_to_mode(f: DataFrame, grid: Grid, u: DataFrame | None = None, dealiasing=_OT, invariant=_KE, max_modes: int = 1024, force: bool = False, dense: bool = False, method: str = "sql", m: int | None = None) -> ModeTransfer:
    """S(k, p): one giver mode p. Its number of rows is the square of the modes', hence the guard.

    Pairs whose triad has no mode have no row; with ``dense`` every two modes have one.
    """
    if grid.size > max_modes and not force:
        raise ValueError(f"{grid.size} modes; over {max_modes} only with force=True")
    D.check(invariant, grid)
    f, u, m = M.read_often(f, u, m, grid)
    givers, ks = [f"p{d}" for d in range(grid.nd)], [f"k{d}" for d in range(grid.nd)]
    if engine(method) == FFT:
        pairs = _fused_modes(u, f, grid, m, dealiasing, invariant)
        if not dense:
            pairs = pairs.where("s <> 0")
    else:
        given = f.select("*", *(F.col(f"i{d}").alias(p) for d, p in enumerate(givers)))
        term = N.wide_term(u, given, grid, m, dealiasing, f_keys=givers)
        t = D.of_wide(M.widen(f, grid, m, []), term, grid, m, invariant, givers)
        pairs = t.select("field_id", *(F.col(f"i{d}").alias(k) for d, k in enumerate(ks)), *givers, F.col("t").alias("s"))
        if dense:
            every = _fields(f, ["field_id"])
            for d, n in enumerate(grid.ns):
                for name in (ks[d], givers[d]):
                    every = every.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
            on = ["field_id", *ks, *givers]
            pairs = every.join(pairs, on, "left").select(*on, F.coalesce("s", F.lit(0.0)).alias("s"))
    return ModeTransfer(pairs, pairs.groupBy("field_id", *ks).agg(F.sum("s").alias("net")))


def scalar_mode_to_mode(scalar: DataFrame, velocity: DataFrame, grid: Grid, **options) -> ModeTransfer:
    return mode_to_mode(scalar, grid, u=velocity, invariant=PassiveScalar(), **options)


# --- fused routes: transform, density and binning of a stack of fields in one numpy call ---------


def _sides(u: DataFrame, f: DataFrame, grid: Grid, m: int):
    """Rows of the advected field and, if it is another, the velocity."""
    if u is f:
        return stack.together({"f": stack.ready(f, grid, m)}), ["f"]
    width = stack.components(u, grid) if stack.is_packed(u) else grid.nd
    return stack.together({"f": stack.ready(f, grid, m), "u": stack.ready(u, grid, width)}), ["f", "u"]


class _Bins:
    """Sums over shells, as a matrix product with the places' shells or bands."""

    def __init__(self, grid: Grid, geometry, edges: list[float], bands: SmoothBands | None):
        kappa = spectral.magnitude_array(grid, geometry)
        if bands is None:
            shell = S.shell_array(kappa, edges).ravel()
            self.count, self.order = len(edges) - 1, np.argsort(shell, kind="stable")
            self.starts = np.searchsorted(shell[self.order], np.arange(1, len(edges)))
            self.empty = np.bincount(shell, minlength=len(edges))[1:] == 0
            self.parts = [(shell == n).reshape(kappa.shape) for n in range(1, len(edges))]
            self.weights = None
        else:
            self.weights = spectral.band_arrays(bands, kappa)
            self.count, self.parts = len(self.weights), list(self.weights)

    def __call__(self, t: np.ndarray) -> np.ndarray:
        """(field, bin) of (field, place..)."""
        t = t.reshape(len(t), -1)
        if self.weights is not None:
            return t @ self.weights.reshape(self.count, -1).T
        t = t[:, self.order]
        ends = np.append(t, np.zeros((len(t), 1)), axis=1)
        sums = np.add.reduceat(ends, np.minimum(self.starts, t.shape[1]), axis=1) if self.count else np.zeros((len(t), 0))
        return np.where(self.empty, 0.0, sums)


def _fused_flux(u: DataFrame, f: DataFrame, grid: Grid, m: int, dealiasing, invariant, geometry, binning, edges: list[float]) -> DataFrame:
    """field_id, shell, k_shell, transfer, flux: no shuffle but that which packs long modes."""
    density, centers = D.array_form(invariant), S.shell_centers(binning, edges)
    rows, sides = _sides(u, f, grid, m)

    def run(f, u=None):
        kernel, bins = N.Kernel(grid, dealiasing), _Bins(grid, geometry, edges, None)
        t = bins(density(f, kernel.term(kernel.velocity(f if u is None else u), f), kernel.k))
        shell = stack.constant(np.arange(1, len(edges), dtype=np.int32), len(f))
        return {"shell": shell, "k_shell": stack.constant(np.asarray(centers, float), len(f)), "transfer": t, "flux": np.cumsum(t, axis=1)}

    return stack.mapped(rows, grid, sides, [], "shell int, k_shell double, transfer double, flux double", run, width=3)


def _fused_matrix(u: DataFrame, f: DataFrame, grid: Grid, m: int, dealiasing, invariant, geometry, edges: list[float], bands: SmoothBands | None) -> DataFrame:
    """field_id, n, m, transfer: every cell."""
    density = D.array_form(invariant)
    rows, sides = _sides(u, f, grid, m)

    def run(f, u=None):
        kernel, bins = N.Kernel(grid, dealiasing), _Bins(grid, geometry, edges, bands)
        velocity, n = kernel.velocity(f if u is None else u), bins.count
        out = np.zeros((len(f), n, n))
        for giver, part in enumerate(bins.parts):
            if kernel.padded or kernel.mask is None or np.any(part * kernel.mask):  # a giver that the rule takes off gives nothing
                out[:, :, giver] = bins(density(f, kernel.term(velocity, f * part), kernel.k))
        at = np.arange(1, n + 1, dtype=np.int32)
        return {"n": stack.constant(np.repeat(at, n), len(f)), "m": stack.constant(np.tile(at, n), len(f)), "transfer": out.reshape(len(f), -1)}

    return stack.mapped(rows, grid, sides, [], "n int, m int, transfer double", run, width=3)


def _fused_modes(u: DataFrame, f: DataFrame, grid: Grid, m: int, dealiasing, invariant) -> DataFrame:
    """field_id, k.., p.., s of every two modes; givers go through the transforms a stack at a time."""
    density = D.array_form(invariant)
    rows, sides = _sides(u, f, grid, m)
    made = ", ".join([*(f"{x}{d} int" for x in "kp" for d in range(grid.nd)), "s double"])

    def run(f, u=None):
        kernel, size = N.Kernel(grid, dealiasing), grid.size
        velocity = kernel.velocity(f if u is None else u)
        out = np.zeros((len(f), size, size))
        step = max(1, stack.STACK // (m * size))
        # a giver that the rule takes off gives nothing
        kept = np.arange(size) if kernel.mask is None else np.flatnonzero(kernel.mask)
        for one in range(len(f)):
            for first in range(0, len(kept), step):
                givers = kept[first : first + step]
                single = np.zeros((len(givers), *f.shape[1:]), complex)
                flat = single.reshape(len(givers), f.shape[1], -1)
                flat[np.arange(len(givers)), :, givers] = f[one].reshape(f.shape[1], -1)[:, givers].T
                t = density(f[one : one + 1], kernel.term(velocity[one : one + 1], single), kernel.k)
                out[one, :, givers] = t.reshape(len(givers), -1)
        index = np.indices(grid.ns).reshape(grid.nd, -1).astype(np.int32)
        columns = {f"k{d}": stack.constant(np.repeat(index[d], size), len(f)) for d in range(grid.nd)} | {f"p{d}": stack.constant(np.tile(index[d], size), len(f)) for d in range(grid.nd)}
        return columns | {"s": out.reshape(len(f), -1)}

    return stack.mapped(rows, grid, sides, [], made, run, width=grid.size)


def _fused_parts(parts: DataFrame, grid: Grid, m: int, dealiasing, geometry, names: tuple[str, ...], binning, edges: list[float]) -> DataFrame:
    """Partial fluxes: the parts of a field side by side in one packed row."""
    number = F.array_position(F.array(*map(F.lit, names)), F.col("component")).cast("int") - 1
    rows = parts.withColumn("c", number * m + F.col("c"))
    rows = stack.together({"f": stack.pack(rows, grid, m * len(names))})
    centers, p, shells = S.shell_centers(binning, edges), len(names), len(edges) - 1

    def run(f):
        kernel, bins = N.Kernel(grid, dealiasing), _Bins(grid, geometry, edges, None)
        own = f.reshape(len(f), p, m, *grid.ns)
        out = np.zeros((len(f), p, p, p, shells))  # carrier, advecting, advected
        for a in range(p):
            velocity = kernel.velocity(own[:, a])
            for b in range(p):
                term = kernel.term(velocity, own[:, b])
                for c in range(p):
                    out[:, c, a, b] = bins((own[:, c].conj() * term).sum(1).real)
        index = np.indices(out.shape[1:]).reshape(4, -1).astype(np.int32)
        made = {f"n{i}": stack.constant(index[i], len(f)) for i in range(4)}
        return made | {"transfer": out.reshape(len(f), -1), "flux": np.cumsum(out, axis=-1).reshape(len(f), -1)}

    got = stack.mapped(rows, grid, ["f"], [], "n0 int, n1 int, n2 int, n3 int, transfer double, flux double", run, width=3)
    name = lambda i, alias: F.element_at(F.array(*map(F.lit, names)), F.col(f"n{i}") + 1).alias(alias)
    center = F.element_at(F.array(*(F.lit(float(c)) for c in centers)), F.col("n3") + 1)
    return got.select("field_id", name(0, "s_k"), name(1, "s_p"), name(2, "s_q"), (F.col("n3") + 1).alias("shell"), center.alias("k_shell"), "transfer", "flux")


#: Of the budget's terms: receiver, carrier, velocity, advected field, sign.
_BUDGET = (("kinetic", "u", "u", "u", 1), ("kinetic", "u", "b", "b", -1), ("magnetic", "b", "u", "b", 1), ("magnetic", "b", "b", "u", -1))


def total_energy_budget(u: DataFrame, b: DataFrame, grid: Grid, binning=None, dealiasing=_OT, method: str = "sql") -> DataFrame:
    """Shell budget of kinetic and magnetic energy: field_id, shell, k_shell, kinetic, magnetic, total."""
    binning, edges = S.edges_of(grid, binning)
    m = grid.nd
    if engine(method) == FFT:
        rows, centers = stack.together({"u": stack.ready(u, grid, m), "b": stack.ready(b, grid, m)}), S.shell_centers(binning, edges)

        def run(u, b):
            kernel, bins = N.Kernel(grid, dealiasing), _Bins(grid, _ISO, edges, None)
            own = {"u": u[:, :m], "b": b[:, :m]}
            velocity = {k: kernel.velocity(v) for k, v in own.items()}
            out = {"kinetic": 0.0, "magnetic": 0.0}
            for kind, carrier, by, of, sign in _BUDGET:
                out[kind] = out[kind] + sign * bins((own[carrier].conj() * kernel.term(velocity[by], own[of])).sum(1).real)
            shell = stack.constant(np.arange(1, len(edges), dtype=np.int32), len(u))
            return {"shell": shell, "k_shell": stack.constant(np.asarray(centers, float), len(u)), **out, "total": out["kinetic"] + out["magnetic"]}

        return stack.mapped(rows, grid, ["u", "b"], [], "shell int, k_shell double, kinetic double, magnetic double, total double", run, width=3)
    sides = {"u": M.once(u), "b": M.once(b)}
    # one join for all: velocities and advected fields told by name, of which four meet
    named = M.once(sides["u"].select(*M.place(grid), "c", "re", "im", F.lit("u").alias("side")).unionByName(sides["b"].select(*M.place(grid), "c", "re", "im", F.lit("b").alias("side"))))
    side = lambda k: named.withColumnRenamed("side", k)
    term = N.wide_term(side("by"), side("of"), grid, m, dealiasing, ["by"], ["of"])
    t = D.of_wide(M.widen(side("carrier"), grid, m, ["carrier"]), term, grid, m, _KE, ["carrier", "by", "of"])
    shell = S.shell_of(spectral.magnitude(grid), edges)
    is_one = lambda c, by, of: (F.col("carrier") == c) & (F.col("by") == by) & (F.col("of") == of)
    total = lambda kind: spectral.add([F.sum(F.when(is_one(c, by, of), sign * F.col("t")).otherwise(0.0)) for k, c, by, of, sign in _BUDGET if k == kind])
    sums = t.withColumn("shell", shell).where("shell > 0").groupBy("field_id", "shell").agg(total("kinetic").alias("kinetic"), total("magnetic").alias("magnetic"))
    sums = sums.withColumn("transfer", F.col("kinetic") + F.col("magnetic"))
    return _filled(sums, sides["u"], ["field_id"], edges, binning).na.fill(0.0).withColumnRenamed("transfer", "total")
