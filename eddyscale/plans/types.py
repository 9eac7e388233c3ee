"""Parameters: what to compute, as plain values.

Every family is open.  Of another's own: an invariant is registered with ``density.register``; a
binning has ``edges_to(k_max)`` and may have ``centers(edges)``; a filter has ``column(k, scale)`` and
``array(k, scale)``; a decomposition has ``parts`` and ``split(wide, m)``; a dealiasing rule has
``keeps(n)`` and ``length(n)``; a geometry has ``dims``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Grid:
    """A periodic grid: points and length along each axis. Indices count from 0.

    ``waves``: for an axis whose wavenumbers follow no rule, one for each index; None for others.
    """

    ns: tuple[int, ...]
    lengths: tuple[float, ...] | None = None
    waves: tuple[tuple[float, ...] | None, ...] | None = None

    def __post_init__(self):
        import math

        if not self.ns or min(self.ns) < 1:
            raise ValueError("a grid has at least one point along each axis")
        if self.lengths is None:
            object.__setattr__(self, "lengths", (2 * math.pi,) * len(self.ns))
        if len(self.lengths) != len(self.ns) or min(self.lengths) <= 0:
            raise ValueError("one positive length for each axis")
        if self.waves is not None and [len(w) if w is not None else n for w, n in zip(self.waves, self.ns, strict=True)] != list(self.ns):
            raise ValueError("one wavenumber for each index of an axis")

    @property
    def nd(self) -> int:
        return len(self.ns)

    @property
    def size(self) -> int:
        out = 1
        for n in self.ns:
            out *= n
        return out


# Invariants: what is exchanged. ``dims`` limits the dimension.
@dataclass(frozen=True)
class KineticEnergy:
    dims: tuple[int, ...] = (1, 2, 3)


@dataclass(frozen=True)
class PassiveScalar:
    dims: tuple[int, ...] = (1, 2, 3)


@dataclass(frozen=True)
class Helicity:
    dims: tuple[int, ...] = (3,)


@dataclass(frozen=True)
class Enstrophy:
    dims: tuple[int, ...] = (2, 3)


# Decompositions: named parts of a vector field.
@dataclass(frozen=True)
class NoDecomposition:
    parts: tuple[str, ...] = ()


@dataclass(frozen=True)
class HelmholtzDecomposition:
    parts: tuple[str, ...] = ("rotational", "divergent")


@dataclass(frozen=True)
class RotationalDecomposition:
    parts: tuple[str, ...] = ("rotational",)


@dataclass(frozen=True)
class DivergentDecomposition:
    parts: tuple[str, ...] = ("divergent",)


@dataclass(frozen=True)
class HelicalDecomposition:
    parts: tuple[str, ...] = ("positive", "negative")


@dataclass(frozen=True)
class ToroidalPoloidalDecomposition:
    parts: tuple[str, ...] = ("toroidal", "poloidal")


# Filters of coarse graining.
@dataclass(frozen=True)
class SharpSpectralFilter:
    pass


@dataclass(frozen=True)
class GaussianFilter:
    pass


@dataclass(frozen=True)
class TopHatFilter:
    pass


# Shell binnings.
@dataclass(frozen=True)
class LinearBinning:
    dk: float


@dataclass(frozen=True)
class LogarithmicBinning:
    k0: float
    ratio: float = 2.0


@dataclass(frozen=True)
class DyadicBinning:
    k0: float


@dataclass(frozen=True)
class CustomBinning:
    edges: tuple[float, ...]


@dataclass(frozen=True)
class SmoothBands:
    """Overlapping bands, Gaussian in log wavenumber, that sum to one at every mode."""

    centers: tuple[float, ...]
    logwidth: float = 0.6

    def __post_init__(self):
        if not self.centers or min(self.centers) <= 0 or self.logwidth <= 0:
            raise ValueError("bands have positive centers and a positive width")


# Dealiasing: along an axis of n points, which modes take part, and how long the transforms are.
@dataclass(frozen=True)
class NoDealiasing:
    def keeps(self, n: int) -> list[bool]:
        return [True] * n

    def length(self, n: int) -> int:
        return n


@dataclass(frozen=True)
class OrszagTwoThirds:
    """Modes nearer to zero than a third of the axis, rounded down."""

    def keeps(self, n: int) -> list[bool]:
        return [min(i, n - i) < n // 3 for i in range(n)]

    def length(self, n: int) -> int:
        return n


@dataclass(frozen=True)
class PaddedThreeHalves:
    """Every mode; transforms are half as long again, and of the axis' parity."""

    def keeps(self, n: int) -> list[bool]:
        return [True] * n

    def length(self, n: int) -> int:
        return n + 2 * -(-n // 4)


@dataclass(frozen=True)
class ShellMagnitude:
    """Shells of the wavenumber's length along ``dims`` (from 0; None: all)."""

    dims: tuple[int, ...] | None = None


def isotropic_shells() -> ShellMagnitude:
    return ShellMagnitude()


def perpendicular_shells(dims: tuple[int, ...] = (0, 1)) -> ShellMagnitude:
    return ShellMagnitude(tuple(dims))


def parallel_shells(dims: tuple[int, ...] = (2,)) -> ShellMagnitude:
    return ShellMagnitude(tuple(dims))


#: How a nonlinear term is made: by joins in the engine, or by an FFT of each field in numpy.
SQL, FFT = "sql", "fft"
_ENGINES = {"sql": SQL, "direct": SQL, "fft": FFT, "auto": FFT}


def engine(name: str) -> str:
    if name not in _ENGINES:
        raise ValueError(f"engine: {name!r}")
    return _ENGINES[name]


# Methods: what the dispatcher runs.
@dataclass(frozen=True)
class SpectralFlux:
    binning: object | None = None


@dataclass(frozen=True)
class ShellToShell:
    binning: object | None = None


@dataclass(frozen=True)
class ModeToMode:
    invariant: object = field(default_factory=KineticEnergy)


@dataclass(frozen=True)
class CoarseGraining:
    filter: object
    scale: float


@dataclass(frozen=True)
class MaskedCoarseGraining:
    """Of points with a column ``wet``; ``parts``: tiles along each axis."""

    filter: object
    scale: float
    parts: int | tuple[int, ...] | None = None


@dataclass(frozen=True)
class TriadicDecomposition:
    nfft: int | None = None
    noverlap: int | None = None
    nmode: int | None = None


Reducer = str | Callable
