"""Transfer density t(k) = Re{conj(c(k)) N(k)} of each invariant."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import Enstrophy, Grid, Helicity, KineticEnergy, PassiveScalar
from . import modes as M

Complex = tuple[Column, Column]


def check(invariant, grid: Grid) -> None:
    if grid.nd not in invariant.dims:
        raise ValueError(f"{type(invariant).__name__} isn't defined in {grid.nd} dimensions")


def _times_i(z: Complex) -> Complex:
    return -z[1], z[0]


def _minus(a: Complex, b: Complex) -> Complex:
    return a[0] - b[0], a[1] - b[1]


def curl(v: list[Complex], k: list[Column]) -> list[Complex]:
    """i k x v: three components in 3D, one in 2D."""
    cross = lambda a, b: _minus((k[a] * v[b][0], k[a] * v[b][1]), (k[b] * v[a][0], k[b] * v[a][1]))
    return [_times_i(cross(a, b)) for a, b in ([(0, 1)] if len(k) == 2 else [(1, 2), (2, 0), (0, 1)])]


def _dot(a: list[Complex], b: list[Complex]) -> Column:
    return spectral.add([x[0] * y[0] + x[1] * y[1] for x, y in zip(a, b, strict=False)])


#: How each invariant is made of carrier, term and wavenumbers; ``register`` adds to it.
_EXPRESSIONS = {
    KineticEnergy: lambda c, n, k: _dot(c, n),
    PassiveScalar: lambda c, n, k: _dot(c, n),
    Helicity: lambda c, n, k: _dot(curl(c, k), n),
    Enstrophy: lambda c, n, k: _dot(curl(c, k), curl(n, k)),
}


def _curl_array(v: np.ndarray, k: list[np.ndarray]) -> np.ndarray:
    """Of arrays (field, component, place..)."""
    pairs = [(0, 1)] if len(k) == 2 else [(1, 2), (2, 0), (0, 1)]
    return np.stack([1j * (k[a] * v[:, b] - k[b] * v[:, a]) for a, b in pairs], 1)


def _dot_array(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    m = min(a.shape[1], b.shape[1])
    return (a[:, :m].conj() * b[:, :m]).sum(1).real


_ARRAYS = {
    KineticEnergy: lambda c, n, k: _dot_array(c, n),
    PassiveScalar: lambda c, n, k: _dot_array(c, n),
    Helicity: lambda c, n, k: _dot_array(_curl_array(c, k), n),
    Enstrophy: lambda c, n, k: _dot_array(_curl_array(c, k), _curl_array(n, k)),
}


def register(kind: type, expression, array) -> None:
    """A further invariant: its class, column expression and numpy form."""
    _EXPRESSIONS[kind], _ARRAYS[kind] = expression, array


def array_form(invariant):
    """The numpy form, a function of carrier, term and wavenumbers; looked up on the driver, for kernels to take along."""
    return _ARRAYS[type(invariant)]


def of_wide(carrier: DataFrame, term: DataFrame, grid: Grid, m: int, invariant, keys: list[str]) -> DataFrame:
    """place, keys, t from a wide carrier (r0, m0, ..) and a wide term; both may have keys."""
    check(invariant, grid)
    held = carrier.withColumnsRenamed({f"{s}{c}": f"c{c}{s}" for c in range(m) for s in "rm"})
    both = term.join(held, M.place(grid))
    c = [(F.col(f"c{i}r"), F.col(f"c{i}m")) for i in range(m)]
    n = [(F.col(f"r{i}"), F.col(f"m{i}")) for i in range(m)]
    return both.select(*M.place(grid), *keys, _EXPRESSIONS[type(invariant)](c, n, spectral.wavenumbers(grid)).alias("t"))


def transfer_density(carrier: DataFrame, term: DataFrame, grid: Grid, invariant=KineticEnergy(), keys: list[str] | None = None, m: int | None = None) -> DataFrame:  # noqa: B008
    """field_id, indices, keys, t of long modes; ``keys``: columns of either side that tell rows apart."""
    carrier, term, keys = M.as_component_field(carrier), M.as_component_field(term), keys or []
    m = m or M.components(carrier)
    sides = [M.widen(x, grid, m, [k for k in keys if k in x.columns]) for x in (carrier, term)]
    return of_wide(*sides, grid, m, invariant, keys)
