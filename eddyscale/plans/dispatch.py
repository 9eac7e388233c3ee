"""One entry for all methods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import coarse, pencil, sphere, tod, transfer
from ..operators import transforms as T
from . import types as P


def calculate_energy_transfer(method, field: DataFrame, grid: P.Grid | None = None, /, **options):
    """Run ``method`` (a value of ``plans.types``) on modes, points or a series."""
    if isinstance(method, P.SpectralFlux):
        if options.pop("whole", True) is False:  # a field too large for a task
            return pencil.spectral_flux(field, grid, binning=method.binning, **options)
        return transfer.spectral_flux(field, grid, binning=method.binning, **options)
    if isinstance(method, P.ShellToShell):
        return transfer.shell_to_shell(field, grid, binning=method.binning, **options)
    if isinstance(method, P.ModeToMode):
        return transfer.mode_to_mode(field, grid, invariant=method.invariant, **options)
    if isinstance(method, P.CoarseGraining):
        return coarse.flux_map(field, grid, method.filter, method.scale, **options)
    if isinstance(method, P.MaskedCoarseGraining):
        return coarse.masked_flux_map(field, grid, method.filter, method.scale, parts=method.parts, **options)
    if isinstance(method, P.TriadicDecomposition):
        return tod.tod(field, window=method.nfft, noverlap=method.noverlap, nmode=method.nmode, **options)
    raise TypeError(f"method: {method!r}")


def from_points(method, points: DataFrame, grid: P.Grid, /, **options):
    """The spectra front-end: points are transformed first, except for methods of physical space."""
    if isinstance(method, (P.CoarseGraining, P.MaskedCoarseGraining, P.TriadicDecomposition)):
        return calculate_energy_transfer(method, points, grid, **options)
    return calculate_energy_transfer(method, T.forward(points, grid, "fft"), grid, **options)


def from_sphere(method, points: DataFrame, lmax: int, /, nrings: int | None = None, nphi: int | None = None, components: int = 2, kind: str = "equiangular", by_order: bool = False, tolerance: float | None = None, **options):
    """The spherical front-end: points on rings (i0, i1), or anywhere (theta, phi), by their coefficients up to ``lmax``."""
    if {"theta", "phi"} <= set(points.columns):
        found = sphere.spherical_analysis(points, lmax, tolerance, list(range(components)))
    else:
        nrings = nrings or lmax + 1
        found = sphere.ring_analysis(points, nrings, nphi or 2 * nrings, lmax, components, kind)
    return calculate_energy_transfer(method, sphere.as_modes(found, lmax, by_order), sphere.coefficient_grid(lmax, by_order), **options)
