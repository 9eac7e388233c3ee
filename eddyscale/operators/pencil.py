"""One field over many tasks: transforms axis by axis, between which its blocks change places.

A grid is cut into blocks, ``parts`` along each axis, a row each: field_id, b0.., z, the block's complex
numbers as bytes, all channels (components, gradients) one after another.  For a transform along an
axis the blocks that lie behind one another along it meet in a *pencil*, a group of its own; the
pencil is transformed by numpy and cut into blocks again.  So each axis and direction costs one
shuffle, and a task holds one pencil: of a grid of n^d points n^d / parts^(d-1) of them.

The nonlinear term needs every gradient in physical space, but a gradient along an axis is a factor
at hand while that axis is still spectral: it is made there, so that the first exchanges carry
fewer channels.  The last axis goes to physical space, is multiplied out and comes back in one
pencil.  A flux of d axes therefore takes 2 (d - 1) + 1 shuffles of blocks, and one in which the
carrier meets the term; what is left are sums by shell.

Use this where a field is too large for a task; ``method="fft"`` of the other operators holds a field
in one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import Grid, KineticEnergy, OrszagTwoThirds, PassiveScalar, ShellMagnitude
from . import density as D
from . import modes as M
from . import shells as S

_OT, _KE, _ISO = OrszagTwoThirds(), KineticEnergy(), ShellMagnitude()
#: Numbers of a pencil that a task should hold, all channels of it, about: 256 MB.
PENCIL = 1 << 24


@dataclass(frozen=True)
class Cut:
    """Blocks along each axis."""

    parts: tuple[int, ...]

    def edges(self, d: int, n: int) -> np.ndarray:
        return np.arange(self.parts[d] + 1) * n // self.parts[d]

    def block(self, d: int, n: int, b: int) -> slice:
        edges = self.edges(d, n)
        return slice(int(edges[b]), int(edges[b + 1]))

    @property
    def names(self) -> list[str]:
        return [f"b{d}" for d in range(len(self.parts))]


def cut_of(grid: Grid, channels: int | None = None, parts: int | tuple[int, ...] | None = None) -> Cut:
    """So many blocks along each axis, or so many that a pencil of all channels isn't over ``PENCIL``."""
    if parts is None:
        parts, channels = 1, channels or grid.nd * (grid.nd + 1)
        while grid.nd > 1 and channels * grid.size / parts ** (grid.nd - 1) > PENCIL and parts < min(grid.ns):
            parts += 1
    each = (parts,) * grid.nd if isinstance(parts, int) else tuple(parts)
    if len(each) != grid.nd or min(each) < 1:
        raise ValueError("one positive number of parts for each axis")
    return Cut(tuple(min(p, n) for p, n in zip(each, grid.ns, strict=True)))


def _schema(df: DataFrame, cut: Cut) -> str:
    return f"field_id {df.schema['field_id'].dataType.simpleString()}, {', '.join(f'{b} int' for b in cut.names)}, z binary"


def blocks(rows: DataFrame, grid: Grid, m: int, cut: Cut, values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """Blocks of long rows (field_id, i0.., c, values); rows of one place are summed."""
    at = [F.greatest(*(F.when(F.col(f"i{d}") >= int(e), F.lit(b)).otherwise(0) for b, e in enumerate(cut.edges(d, n)[:-1])), F.lit(0)).cast("int").alias(f"b{d}") for d, n in enumerate(grid.ns)]
    own = rows.where(F.col("c") < m).select("field_id", *at, *(F.col(f"i{d}").cast("int").alias(f"i{d}") for d in range(grid.nd)), F.col("c").cast("int").alias("c"), *(F.col(v).cast("double").alias(v) for v in values))

    def run(table: pa.Table) -> pa.Table:
        b = [table.column(n)[0].as_py() for n in cut.names]
        where = [cut.block(d, n, b[d]) for d, n in enumerate(grid.ns)]
        shape = (m, *(s.stop - s.start for s in where))
        flat = np.ravel_multi_index((table.column("c").to_numpy(), *(table.column(f"i{d}").to_numpy() - s.start for d, s in enumerate(where))), shape)
        parts = [np.bincount(flat, table.column(v).to_numpy(), int(np.prod(shape))) for v in values]
        z = parts[0] + 1j * parts[1] if len(parts) == 2 else parts[0].astype(complex)
        return _rows(table, [(b, z)], cut)

    return own.groupBy("field_id", *cut.names).applyInArrow(run, _schema(rows, cut))


def _rows(table: pa.Table, made: list[tuple[list[int], np.ndarray]], cut: Cut) -> pa.Table:
    """Rows of one field's blocks."""
    field = table.column("field_id").combine_chunks().take(pa.array([0] * len(made), pa.int64()))
    columns = [pa.array([b[d] for b, _ in made], pa.int32()) for d in range(len(cut.parts))]
    return pa.table([field, *columns, pa.array([np.ascontiguousarray(z, complex).tobytes() for _, z in made], pa.binary())], names=["field_id", *cut.names, "z"])


def _pencil(table: pa.Table, cut: Cut, sizes: tuple[int, ...], d: int, channels: int | None = None) -> tuple[np.ndarray, list[slice]]:
    """(channel, place..) of the blocks behind one another along ``d``, and the places; missing blocks are zero.

    Where blocks hold some of the channels only, a column ``first`` names their first one.
    """
    b = [table.column(n)[0].as_py() for n in cut.names]
    where = [slice(0, n) if e == d else cut.block(e, n, b[e]) for e, n in enumerate(sizes)]
    shape, out = tuple(s.stop - s.start for s in where), None
    firsts = table.column("first").to_pylist() if "first" in table.column_names else [0] * table.num_rows
    for own, first, z in zip(table.column(f"b{d}").to_pylist(), firsts, table.column("z"), strict=True):
        part = cut.block(d, sizes[d], own)
        z = np.frombuffer(z.as_buffer(), complex).reshape(-1, *shape[:d], part.stop - part.start, *shape[d + 1 :])
        if out is None:
            out = np.zeros((channels or len(z), *shape), complex)
        out[(slice(first, first + len(z)), *(part if e == d else slice(None) for e in range(len(sizes))))] += z
    return out, where


def along(df: DataFrame, cut: Cut, sizes: tuple[int, ...], d: int, work: Callable[[np.ndarray, list[slice]], np.ndarray], to: int, channels: int | None = None) -> DataFrame:
    """Blocks again, after ``work`` on every pencil along ``d``, which makes it ``to`` places long: one shuffle."""

    def run(table: pa.Table) -> pa.Table:
        made = work(*_pencil(table, cut, sizes, d, channels))
        b = [table.column(n)[0].as_py() for n in cut.names]
        parts = [([k if e == d else b[e] for e in range(len(b))], made.take(range(*cut.block(d, to, k).indices(to)), axis=d + 1)) for k in range(cut.parts[d])]
        return _rows(table, parts, cut)

    keys = ["field_id", *(n for e, n in enumerate(cut.names) if e != d)]
    return df.groupBy(*keys).applyInArrow(run, _schema(df, cut))


class Axis:
    """One axis of a dealiasing rule: which modes take part, and their places in a transform that may be longer."""

    def __init__(self, n: int, k: np.ndarray, dealiasing):
        self.n, self.long, self.k = n, dealiasing.length(n), k
        self.kept = np.flatnonzero(dealiasing.keeps(n))
        self.there = np.where(self.kept < (n + 1) // 2, self.kept, self.kept - n) % self.long

    def _at(self, index: np.ndarray, d: int, nd: int) -> tuple:
        return (slice(None), *(index if e == d else slice(None) for e in range(nd)))

    def inverse(self, x: np.ndarray, d: int) -> np.ndarray:
        nd = x.ndim - 1
        wide = np.zeros((*x.shape[: d + 1], self.long, *x.shape[d + 2 :]), complex)
        wide[self._at(self.there, d, nd)] = x[self._at(self.kept, d, nd)]
        return np.fft.ifft(wide, axis=d + 1)

    def forward(self, x: np.ndarray, d: int) -> np.ndarray:
        nd = x.ndim - 1
        y, out = np.fft.fft(x, axis=d + 1), np.zeros((*x.shape[: d + 1], self.n, *x.shape[d + 2 :]), complex)
        out[self._at(self.kept, d, nd)] = y[self._at(self.there, d, nd)]
        return out

    def slope(self, x: np.ndarray, d: int) -> np.ndarray:
        return x * (1j * self.k).reshape([-1 if e == d + 1 else 1 for e in range(x.ndim)])


def axes_of(grid: Grid, dealiasing) -> list[Axis]:
    return [Axis(n, k, dealiasing) for n, k in zip(grid.ns, spectral.axes(grid), strict=True)]


def transformed(df: DataFrame, grid: Grid, cut: Cut, forward: bool = True) -> DataFrame:
    """Blocks of modes from blocks of points (the sum times 1/Np), or the real part's points from modes (the plain sum)."""
    for d in range(grid.nd):
        last = d == grid.nd - 1
        one = (lambda x, _, d=d: np.fft.fft(x, axis=d + 1) / x.shape[d + 1]) if forward else (lambda x, _, d=d, last=last: (lambda y: y.real if last else y)(np.fft.ifft(x, axis=d + 1) * x.shape[d + 1]))
        df = along(df, cut, grid.ns, d, one, grid.ns[d])
    return df


def unblock(df: DataFrame, grid: Grid, cut: Cut, values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """Long rows (field_id, i0.., c, values) of blocks."""
    kinds = ", ".join([f"field_id {df.schema['field_id'].dataType.simpleString()}", *(f"i{d} int" for d in range(grid.nd)), "c int", *(f"{v} double" for v in values)])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                where = [cut.block(d, n, batch.column(d + 1)[r].as_py()) for d, n in enumerate(grid.ns)]
                shape = [s.stop - s.start for s in where]
                z = np.frombuffer(batch.column(grid.nd + 1)[r].as_buffer(), complex).reshape(-1, *shape)
                index = np.indices(z.shape).reshape(grid.nd + 1, -1).astype(np.int32)
                parts = {"re": z.real.ravel(), "im": z.imag.ravel()}
                columns = [*(pa.array(index[d + 1] + np.int32(where[d].start)) for d in range(grid.nd)), pa.array(index[0]), *(pa.array(parts["im" if v == "im" else "re"]) for v in values)]
                for at in range(0, z.size, 1 << 16):
                    some = [c.slice(at, 1 << 16) for c in columns]
                    field = batch.column(0).take(pa.array(np.full(len(some[0]), r)))
                    yield pa.RecordBatch.from_arrays([field, *some], names=["field_id", *(f"i{d}" for d in range(grid.nd)), "c", *values])

    return df.select("field_id", *cut.names, "z").mapInArrow(run, kinds)


def columns(df: DataFrame, grid: Grid, cut: Cut, names: list[str]) -> DataFrame:
    """(field_id, i0.., names) of blocks: a row each place, its channels' real parts as columns."""
    kinds = ", ".join([f"field_id {df.schema['field_id'].dataType.simpleString()}", *(f"i{d} int" for d in range(grid.nd)), *(f"{n} double" for n in names)])

    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                where = [cut.block(d, n, batch.column(d + 1)[r].as_py()) for d, n in enumerate(grid.ns)]
                shape = [s.stop - s.start for s in where]
                z = np.frombuffer(batch.column(grid.nd + 1)[r].as_buffer(), complex).reshape(len(names), -1).real
                index = np.indices(shape).reshape(grid.nd, -1).astype(np.int32)
                for at in range(0, z.shape[1], 1 << 16):
                    some = slice(at, at + (1 << 16))
                    own = [pa.array(index[d, some] + np.int32(where[d].start)) for d in range(grid.nd)]
                    field = batch.column(0).take(pa.array(np.full(len(own[0]), r)))
                    yield pa.RecordBatch.from_arrays([field, *own, *(pa.array(np.ascontiguousarray(one[some])) for one in z)], names=["field_id", *(f"i{d}" for d in range(grid.nd)), *names])

    return df.select("field_id", *cut.names, "z").mapInArrow(run, kinds)


def term_blocks(f: DataFrame, grid: Grid, m: int, cut: Cut, u: DataFrame | None = None, dealiasing=_OT, axes: list[Axis] | None = None) -> tuple[DataFrame, tuple[int, ...]]:
    """Blocks of (u . grad) f, all but the first axis transformed, and their lengths: the first is the caller's last step."""
    nd = grid.nd
    axes = axes or axes_of(grid, dealiasing)
    first_u, base = (0, m) if u is None else (m, m + nd)
    own = ["field_id", *cut.names, "z"]
    rows = f.select(*own) if u is None else f.select(*own, F.lit(0).alias("first")).unionByName(u.select(*own, F.lit(m).alias("first")))
    sizes = list(grid.ns)

    def back(x, _, d):
        return axes[d].inverse(np.concatenate([x, axes[d].slope(x[:m], d)]), d)

    def multiplied(x, where):
        d = nd - 1
        x = back(x, where, d).real
        product = sum(x[first_u + j, None] * x[base + j * m : base + (j + 1) * m] for j in range(nd))
        return product if d == 0 else axes[d].forward(product, d)

    for d in range(nd - 1):
        rows = along(rows, cut, tuple(sizes), d, lambda x, w, d=d: back(x, w, d), axes[d].long, None if d else base)
        sizes[d] = axes[d].long
    last = axes[nd - 1].n if nd > 1 else axes[0].long
    rows = along(rows, cut, tuple(sizes), nd - 1, multiplied, last, None if nd > 1 else base)
    sizes[nd - 1] = last
    for d in range(nd - 2, 0, -1):
        rows = along(rows, cut, tuple(sizes), d, lambda x, _, d=d: axes[d].forward(x, d), axes[d].n)
        sizes[d] = axes[d].n
    return rows, tuple(sizes)


def _scale(grid: Grid, axes: list[Axis]) -> float:
    return float(np.prod([float(a.long) for a in axes])) / float(grid.size) ** 2


def nonlinear_term(f: DataFrame, grid: Grid, m: int, u: DataFrame | None = None, dealiasing=_OT, parts: int | tuple[int, ...] | None = None) -> DataFrame:
    """Long modes of DFT[(u . grad) f] of long modes."""
    cut = cut_of(grid, None, parts)
    axes = axes_of(grid, dealiasing)
    rows, sizes = term_blocks(blocks(f, grid, m, cut), grid, m, cut, None if u is None else blocks(u, grid, grid.nd, cut), dealiasing, axes)
    scale = _scale(grid, axes)
    return unblock(along(rows, cut, sizes, 0, lambda x, _: axes[0].forward(x, 0) * scale, axes[0].n), grid, cut)


def spectral_flux(f: DataFrame, grid: Grid, m: int | None = None, u: DataFrame | None = None, binning=None, dealiasing=_OT, invariant=_KE, geometry: ShellMagnitude = _ISO, parts: int | tuple[int, ...] | None = None) -> DataFrame:
    """field_id, shell, k_shell, transfer, flux of long modes, or of blocks (z) cut by ``cut_of(grid, None, parts)``."""
    from .transfer import _filled, _flux

    D.check(invariant, grid)
    binning, edges = S.edges_of(grid, binning, geometry)
    cut, nd = cut_of(grid, None, parts), grid.nd
    if "z" not in f.columns:
        f = M.once(M.as_component_field(f))
        m = m or M.components(f)
        f = M.once(blocks(f, grid, m, cut))
    elif m is None:
        raise ValueError("blocks don't tell the number of components")
    if u is not None and "z" not in u.columns:
        u = blocks(u, grid, nd, cut)
    axes = axes_of(grid, dealiasing)
    rows, sizes = term_blocks(f, grid, m, cut, u, dealiasing, axes)
    density, scale, dims = D.array_form(invariant), _scale(grid, axes), spectral._dims(grid, geometry)

    def run(term: pa.Table, carrier: pa.Table) -> pa.Table:
        if not term.num_rows or not carrier.num_rows:
            return pa.table({"field_id": carrier.column("field_id").slice(0, 0), "shell": pa.array([], pa.int32()), "transfer": pa.array([], pa.float64())})
        n, _ = _pencil(term, cut, sizes, 0)
        c, where = _pencil(carrier, cut, grid.ns, 0)
        k = np.meshgrid(*(a.k[w] for a, w in zip(axes, where, strict=True)), indexing="ij")
        t = density(c[None], axes[0].forward(n, 0)[None] * scale, k)[0]
        shell = S.shell_array(np.sqrt(sum(k[d] ** 2 for d in dims)), edges)
        sums = np.bincount(shell.ravel(), t.ravel(), len(edges))
        there = np.unique(shell)
        there = there[there > 0]
        field = carrier.column("field_id").combine_chunks().take(pa.array([0] * len(there), pa.int64()))
        return pa.table({"field_id": field, "shell": pa.array(there.astype(np.int32)), "transfer": sums[there]})

    keys = ["field_id", *cut.names[1:]]
    kind = f.schema["field_id"].dataType.simpleString()
    parts_of = rows.groupBy(*keys).cogroup(f.groupBy(*keys)).applyInArrow(run, f"field_id {kind}, shell int, transfer double")
    sums = parts_of.groupBy("field_id", "shell").agg(F.sum("transfer").alias("transfer"))
    return _flux(_filled(sums, f.select("field_id"), ["field_id"], edges, binning), ["field_id"])


def scalar_flux(scalar: DataFrame, velocity: DataFrame, grid: Grid, **options) -> DataFrame:
    return spectral_flux(scalar, grid, u=velocity, invariant=PassiveScalar(), **options)
