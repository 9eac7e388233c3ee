"""The nonlinear term: N = DFT[(u . grad) f], with a forward transform's 1/Np and its inverse's.

In index space N(k) = Np^-2 sum over q + p = k (mod N) of U(q) . G(p), U and G being the
Hermitian parts of the velocity and of i p f(p).  As a join: velocity modes meet advected modes
of the same field, and products are summed by k with map-side combining.  Advected (and
velocity) modes may carry giver keys; one join then yields all shell-, band-, mode- or
component-resolved terms.

A join grows with the square of the retained modes.  Both sides are cut into blocks of at most
``BLOCK`` modes by hash, and every block of one meets every block of the other: a small grid is
one unit of work, a larger one is many equal ones, whatever the cluster.  Beyond a few thousand modes
the FFT kernel is the cheaper route; it takes a field as a row, and ``pencil`` one that is too large
for that.  Beyond ``MOST`` modes the joins are refused.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import FFT, Grid, OrszagTwoThirds, engine
from . import modes as M
from . import stack

BLOCK = 512
#: Modes beyond which the joins' square is no longer sensible.
MOST = 1 << 17


def _kept(df: DataFrame, grid: Grid, dealiasing) -> DataFrame:
    rule = spectral.kept(grid, dealiasing)
    return df if rule is None else df.where(rule)


def check_unpadded(grid: Grid, dealiasing) -> None:
    """Joins work in the grid's own modes."""
    if not (callable(getattr(dealiasing, "keeps", None)) and callable(getattr(dealiasing, "length", None))):
        raise TypeError(f"dealiasing: {dealiasing!r}")
    if any(dealiasing.length(n) != n for n in grid.ns):
        raise ValueError("padding needs method='fft'")


def wide_term(u: DataFrame, f: DataFrame, grid: Grid, m: int, dealiasing=OrszagTwoThirds(), u_keys: list[str] | None = None, f_keys: list[str] | None = None, block: int = BLOCK) -> DataFrame:  # noqa: B008
    """Wide N by mode and keys (r0, m0, ..), by joins."""
    check_unpadded(grid, dealiasing)
    u_keys, f_keys, nd = u_keys or [], f_keys or [], grid.nd
    k = spectral.wavenumbers(grid)
    velocity = M.hermitian(_kept(u.where(F.col("c") < nd), grid, dealiasing), grid, nd, u_keys, {"u": (F.col("re"), F.col("im"))})
    gradients = {f"g{j}_": (-k[j] * F.col("im"), k[j] * F.col("re")) for j in range(nd)}
    gradient = M.hermitian(_kept(f, grid, dealiasing), grid, m, f_keys, gradients)
    places = [f"i{d}" for d in range(nd)]
    modes = int(np.prod([sum(dealiasing.keeps(n)) for n in grid.ns]))
    if modes > MOST:
        raise ValueError(f"{modes} modes: joins take at most {MOST}; use method='fft', or pencil for a field too large for a task")
    blocks, on = -(-modes // block), ["field_id"]
    if blocks > 1:
        each, own = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))), F.pmod(F.hash(*places), F.lit(blocks))
        velocity = velocity.withColumn("block_u", own).withColumn("block_f", each)
        gradient = gradient.withColumn("block_f", own).withColumn("block_u", each)
        on += ["block_u", "block_f"]
    velocity = velocity.withColumnsRenamed({p: f"q{p[1:]}" for p in places})
    pairs = velocity.join(gradient, on)
    at = [((F.col(f"q{d}") + F.col(f"i{d}")) % n).cast("int").alias(f"k{d}") for d, n in enumerate(grid.ns)]
    values = []
    for c in range(m):
        both = [((F.col(f"u{j}r"), F.col(f"u{j}m")), (F.col(f"g{j}_{c}r"), F.col(f"g{j}_{c}m"))) for j in range(nd)]
        values.append(spectral.add([a * x - b * y for (a, b), (x, y) in both]).alias(f"r{c}"))
        values.append(spectral.add([a * y + b * x for (a, b), (x, y) in both]).alias(f"m{c}"))
    products = pairs.select("field_id", *at, *u_keys, *f_keys, *values).withColumnsRenamed({f"k{d}": f"i{d}" for d in range(nd)})
    products = _kept(products, grid, dealiasing)
    norm = float(grid.size) ** 2
    return products.groupBy(*M.place(grid), *u_keys, *f_keys).agg(*((F.sum(f"{s}{c}") / norm).alias(f"{s}{c}") for c in range(m) for s in "rm"))


class Kernel:
    """Terms of arrays (field, component, place..), a whole stack of fields in each transform.

    The rule says which modes of an axis take part and how long its transforms are.  ``inside``
    are their places in the grid, ``outside`` those in the transform, both for any direction:
    without padding they are one and the same, and a mask does.
    """

    def __init__(self, grid: Grid, dealiasing):
        self.grid, self.axes = grid, tuple(range(-grid.nd, 0))
        self.k = np.meshgrid(*spectral.axes(grid), indexing="ij")
        self.lengths = tuple(dealiasing.length(n) for n in grid.ns)
        kept = [np.flatnonzero(dealiasing.keeps(n)) for n in grid.ns]
        signed = [np.where(i < (n + 1) // 2, i, i - n) for i, n in zip(kept, grid.ns, strict=True)]
        self.inside = np.ix_(*kept)
        self.outside = np.ix_(*(s % length for s, length in zip(signed, self.lengths, strict=True)))
        self.padded = self.lengths != grid.ns
        mask = np.zeros(grid.ns)
        mask[self.inside] = 1.0
        self.mask = None if mask.all() else mask
        self.scale = np.prod(self.lengths) / grid.size**2

    def physical(self, a: np.ndarray) -> np.ndarray:
        if self.padded:
            wide = np.zeros((*a.shape[: -self.grid.nd], *self.lengths), complex)
            wide[..., *self.outside] = a[..., *self.inside]
            a = wide
        elif self.mask is not None:
            a = a * self.mask
        return np.fft.ifftn(a, axes=self.axes).real

    def spectral(self, x: np.ndarray) -> np.ndarray:
        a = np.fft.fftn(x, axes=self.axes) * self.scale
        if self.padded:
            out = np.zeros((*a.shape[: -self.grid.nd], *self.grid.ns), complex)
            out[..., *self.inside] = a[..., *self.outside]
            return out
        return a if self.mask is None else a * self.mask

    def velocity(self, u: np.ndarray) -> np.ndarray:
        return self.physical(u[:, : self.grid.nd])

    def term(self, velocity: np.ndarray, f: np.ndarray) -> np.ndarray:
        return self.spectral(sum(velocity[:, j : j + 1] * self.physical(1j * self.k[j] * f) for j in range(self.grid.nd)))


def packed_term(u: DataFrame, f: DataFrame, grid: Grid, m: int, dealiasing, u_keys: list[str] | None = None, f_keys: list[str] | None = None) -> DataFrame:
    """Packed terms of each velocity and advected field (each of its keys) of one field_id."""
    u_keys, f_keys = u_keys or [], f_keys or []
    made = "re array<double>, im array<double>"
    if u is f and not u_keys and not f_keys:
        rows, sides = stack.together({"f": stack.ready(f, grid, m)}), ["f"]
    else:
        width = stack.components(u, grid) if stack.is_packed(u) else grid.nd
        rows = stack.together({"f": stack.ready(f, grid, m, f_keys), "u": stack.ready(u, grid, width, u_keys)}, {"f": f_keys, "u": u_keys})
        sides = ["f", "u"]

    def run(f, u=None):
        kernel = Kernel(grid, dealiasing)
        n = kernel.term(kernel.velocity(f if u is None else u), f)
        return {"re": n.real, "im": n.imag}

    return stack.mapped(rows, grid, sides, [*u_keys, *f_keys], made, run, width=2)


def nonlinear_term(f: DataFrame, grid: Grid, u: DataFrame | None = None, dealiasing=OrszagTwoThirds(), method: str = "sql", u_keys: list[str] | None = None, f_keys: list[str] | None = None, m: int | None = None) -> DataFrame:  # noqa: B008
    """Modes of DFT[(u . grad) f], by keys; ``u`` is ``f`` itself if not given.

    Fields are long modes, or packed ones, in which case ``method="fft"`` gives packed terms.
    """
    f, u, m = M.read_often(f, u, m, grid)
    if engine(method) == FFT:
        term = packed_term(u, f, grid, m, dealiasing, u_keys, f_keys)
        return term if stack.is_packed(f) else stack.unpack(term, grid, [*(u_keys or []), *(f_keys or [])])
    wide = wide_term(u, f, grid, m, dealiasing, u_keys, f_keys)
    return M.narrow(wide, grid, m, [*(u_keys or []), *(f_keys or [])])
