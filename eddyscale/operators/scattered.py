"""Transforms of scattered points to a tolerance, in time linear in the points.

A point is spread over the few cells around it of a grid twice as fine, by a compact kernel
exp(b (sqrt(1 - z^2) - 1)); the fine grid is transformed, and each mode is divided by the kernel's own
transform.  From modes to points the same goes backwards.  The kernel's width in cells is the
tolerance's digits and two.

The fine grid is cut into blocks (``pencil``).  Points go to the block they lie in, a crowded block's in
several shares, and each share is spread or read in one task on the block and a rim half a kernel
wide.  Rims are parts of the neighbours: what was spread there is added to them, what is read comes
from them, as boxes of numbers.  The transform goes axis by axis.  So points move once, the grid a
few times, and a task holds a block, a pencil or a share.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import Grid
from . import pencil

#: Points of a share, and numbers that are spread or read at a time, about.
SHARE, STEP = 1 << 18, 1 << 20


class Bump:
    """The kernel on [-1, 1], ``width`` cells of a fine grid."""

    def __init__(self, tolerance: float):
        if not 1e-14 <= tolerance < 1:
            raise ValueError("the tolerance is from 1e-14 to less than 1")
        self.width = math.ceil(-math.log10(tolerance)) + 2
        self.slope = 2.3 * self.width

    def __call__(self, z: np.ndarray) -> np.ndarray:
        inside = np.maximum(1 - z * z, 0.0)
        return np.where(np.abs(z) <= 1, np.exp(self.slope * (np.sqrt(inside) - 1)), 0.0)

    def fine(self, n: int) -> int:
        return max(2 * n, 2 * self.width)

    def correction(self, n: int) -> np.ndarray:
        """Of each mode of an axis, in row order: the fine spacing over the kernel's transform."""
        h = 2 * math.pi / self.fine(n)
        z, weight = np.polynomial.legendre.leggauss(4 * self.width + 60)
        half = self.width * h / 2
        own = half * (np.cos(np.outer(spectral.axis(n) * half, z)) @ (weight * self(z)))
        return h / own

    def around(self, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First cell (point) and weights (point, cell) of the cells around positions, counted in cells."""
        first = np.ceil(position - self.width / 2).astype(np.int64)
        return first, self((first[:, None] + np.arange(self.width) - position[:, None]) * (2 / self.width))


class Mesh:
    """The fine grid of a grid and tolerance, its blocks, and their rims."""

    def __init__(self, grid: Grid, tolerance: float, channels: int, parts=None):
        if not 1 <= grid.nd <= 3:
            raise ValueError("one to three dimensions")
        self.grid, self.bump = grid, Bump(tolerance)
        self.ns = tuple(self.bump.fine(n) for n in grid.ns)
        self.cut = pencil.cut_of(Grid(self.ns), channels, parts)
        self.rim = self.bump.width // 2 + 1
        self.corrections = [self.bump.correction(n) for n in grid.ns]
        self.modes = [np.round(spectral.axis(n)).astype(np.int64) % fine for n, fine in zip(grid.ns, self.ns, strict=True)]

    def block_columns(self) -> list:
        """Of a point's coordinates the block of the cell that it lies in."""
        out = []
        for d, n in enumerate(self.ns):
            cell = F.least(F.floor(F.pmod(F.col(f"x{d}"), F.lit(2 * math.pi)) * (n / (2 * math.pi))), F.lit(n - 1))
            own = F.greatest(F.lit(0), *(F.when(cell >= int(e), b).otherwise(0) for b, e in enumerate(self.cut.edges(d, n)[:-1])))
            out.append(own.cast("int").alias(f"b{d}"))
        return out

    def positions(self, table: pa.Table) -> np.ndarray:
        """(axis, point) in cells."""
        return np.stack([np.mod(table.column(f"x{d}").to_numpy().astype(float), 2 * math.pi) * (n / (2 * math.pi)) for d, n in enumerate(self.ns)])

    def segments(self, d: int, b: int) -> list[tuple[int, slice, slice]]:
        """Block, places in it and places in the rimmed block, of what the block ``b`` and its rim cover along ``d``."""
        n, own, out = self.ns[d], self.cut.block(d, self.ns[d], b), []
        at, stop = own.start - self.rim, own.stop + self.rim
        edges = self.cut.edges(d, n)
        while at < stop:
            owner = int(np.searchsorted(edges, at % n, side="right")) - 1
            end = min(stop, at + int(edges[owner + 1]) - at % n)
            out.append((owner, slice(at % n - int(edges[owner]), at % n - int(edges[owner]) + end - at), slice(at - own.start + self.rim, end - own.start + self.rim)))
            at = end
        return out

    def shape(self, b: list[int], rim: bool) -> tuple[int, ...]:
        sizes = (self.cut.block(d, n, b[d]) for d, n in enumerate(self.ns))
        return tuple(s.stop - s.start + 2 * self.rim * rim for s in sizes)

    def steps(self, table: pa.Table, b: list[int]):
        """(points, flat places in the rimmed block, weights), both (point, cell), some points at a time."""
        at, shape = self.positions(table), self.shape(b, True)
        width, nd = self.bump.width, self.grid.nd
        for some in range(0, at.shape[1], max(1, STEP // width**nd)):
            rows = slice(some, some + max(1, STEP // width**nd))
            flat, weight = 0, 1.0
            for d in range(nd):
                first, w = self.bump.around(at[d, rows])
                cells = first[:, None] - (self.cut.block(d, self.ns[d], b[d]).start - self.rim) + np.arange(width)
                flat = np.expand_dims(flat, -1) * shape[d] + cells.reshape(len(cells), *(1,) * d, width)
                weight = np.expand_dims(weight, -1) * w.reshape(len(w), *(1,) * d, width)
            yield rows, flat.reshape(len(flat), -1), weight.reshape(len(weight), -1)


def _shares(points: DataFrame, mesh: Mesh, by: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points with their block and share, and (field_id, b0.., shares) of the blocks that have any."""
    placed = points.select("*", *mesh.block_columns())
    keys = ["field_id", *mesh.cut.names]
    counts = placed.groupBy(*keys).agg(F.ceil(F.count("*") / SHARE).cast("int").alias("shares"))
    return placed.join(counts, keys).withColumn("share", F.pmod(F.xxhash64(*by), F.col("shares")).cast("int")).drop("shares"), counts


def _boxes(df: DataFrame, mesh: Mesh) -> str:
    return f"field_id {df.schema['field_id'].dataType.simpleString()}, {', '.join(f'{b} int' for b in mesh.cut.names)}, starts array<int>, sizes array<int>, z binary"


def _box_table(table: pa.Table, made: list[tuple[list[int], list[slice], np.ndarray]], mesh: Mesh) -> pa.Table:
    field = table.column("field_id").combine_chunks().take(pa.array([0] * len(made), pa.int64()))
    blocks = [pa.array([b[d] for b, _, _ in made], pa.int32()) for d in range(mesh.grid.nd)]
    starts = pa.array([[s.start for s in at] for _, at, _ in made], pa.list_(pa.int32()))
    sizes = pa.array([[s.stop - s.start for s in at] for _, at, _ in made], pa.list_(pa.int32()))
    return pa.table([field, *blocks, starts, sizes, pa.array([np.ascontiguousarray(z, complex).tobytes() for _, _, z in made], pa.binary())], names=["field_id", *mesh.cut.names, "starts", "sizes", "z"])


def _assembled(table: pa.Table, shape: tuple[int, ...], channels: int) -> np.ndarray:
    """Boxes added up to one array (channel, place..)."""
    out = np.zeros((channels, *shape), complex)
    for starts, sizes, z in zip(table.column("starts").to_pylist(), table.column("sizes").to_pylist(), table.column("z"), strict=True):
        out[(slice(None), *(slice(s, s + n) for s, n in zip(starts, sizes, strict=True)))] += np.frombuffer(z.as_buffer(), complex).reshape(channels, *sizes)
    return out


def _number(components: list[int]):
    return F.array_position(F.array(*map(F.lit, components)), F.col("c")).cast("int") - 1


def forward(points: DataFrame, grid: Grid, components: list[int], tolerance: float = 1e-9, parts=None) -> DataFrame:
    """Modes (field_id, i0.., c, re, im) of points (field_id, x0.., c, value): the sum of value e^{-ikx}."""
    mesh, m, nd = Mesh(grid, tolerance, len(components), parts), len(components), grid.nd
    xs = [f"x{d}" for d in range(nd)]
    rows = points.where(F.col("c").isin(components)).select("field_id", *(F.col(x).cast("double").alias(x) for x in xs), _number(components).alias("c"), F.col("value").cast("double").alias("value"))
    placed, _ = _shares(rows, mesh, [*xs, "c", "value"])

    def spread(table: pa.Table) -> pa.Table:
        b = [table.column(n)[0].as_py() for n in mesh.cut.names]
        shape = mesh.shape(b, True)
        total, size = np.zeros(m * int(np.prod(shape))), int(np.prod(shape))
        c, value = table.column("c").to_numpy().astype(np.int64), table.column("value").to_numpy()
        for some, flat, weight in mesh.steps(table, b):
            total += np.bincount((flat + (c[some] * size)[:, None]).ravel(), (weight * value[some, None]).ravel(), len(total))
        total = total.reshape(m, *shape)
        made = []
        for parts_of in itertools.product(*(mesh.segments(d, b[d]) for d in range(nd))):
            box = total[(slice(None), *(p[2] for p in parts_of))]
            if box.any():
                made.append(([p[0] for p in parts_of], [p[1] for p in parts_of], box))
        return _box_table(table, made, mesh)

    def added(table: pa.Table) -> pa.Table:
        b = [table.column(n)[0].as_py() for n in mesh.cut.names]
        return pencil._rows(table, [(b, _assembled(table, mesh.shape(b, False), m))], mesh.cut)

    boxes = placed.groupBy("field_id", *mesh.cut.names, "share").applyInArrow(spread, _boxes(points, mesh))
    kept = boxes.groupBy("field_id", *mesh.cut.names).applyInArrow(added, pencil._schema(boxes, mesh.cut))
    sizes = list(mesh.ns)
    for d, n in enumerate(grid.ns):
        own = mesh.corrections[d].reshape([-1 if e == d + 1 else 1 for e in range(nd + 1)])
        kept = pencil.along(kept, mesh.cut, tuple(sizes), d, lambda x, _, d=d, own=own: np.fft.fft(x, axis=d + 1).take(mesh.modes[d], axis=d + 1) * own, n)
        sizes[d] = n
    named = F.element_at(F.array(*map(F.lit, components)), F.col("c") + 1)
    return pencil.unblock(kept, grid, mesh.cut).withColumn("c", named.cast("int"))


def inverse(modes: DataFrame, places: DataFrame, grid: Grid, components: list[int], tolerance: float = 1e-9, parts=None) -> DataFrame:
    """(field_id, point, c, value) at places (field_id, point, x0..): the real part of the modes' sum e^{+ikx}."""
    mesh, m, nd = Mesh(grid, tolerance, len(components), parts), len(components), grid.nd
    xs, names = [f"x{d}" for d in range(nd)], mesh.cut.names
    rows = modes.where(F.col("c").isin(components)).withColumn("c", _number(components))
    fine, sizes = pencil.blocks(rows, grid, m, mesh.cut), list(grid.ns)

    def widened(x, d):
        own = mesh.corrections[d].reshape([-1 if e == d + 1 else 1 for e in range(nd + 1)])
        wide = np.zeros((*x.shape[: d + 1], mesh.ns[d], *x.shape[d + 2 :]), complex)
        np.add.at(wide, (slice(None), *(mesh.modes[d] if e == d else slice(None) for e in range(nd))), x * own)
        return np.fft.ifft(wide, axis=d + 1) * mesh.ns[d]

    for d in range(nd):
        fine = pencil.along(fine, mesh.cut, tuple(sizes), d, lambda x, _, d=d: widened(x, d), mesh.ns[d])
        sizes[d] = mesh.ns[d]
    # which blocks' rims a block is part of, along each axis
    wanted = [[[(b, there, here) for b in range(mesh.cut.parts[d]) for owner, here, there in mesh.segments(d, b) if owner == o] for o in range(mesh.cut.parts[d])] for d in range(nd)]

    def lent(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for r in range(table.num_rows):
                row = table.slice(r, 1)
                b = [row.column(n)[0].as_py() for n in names]
                z = np.frombuffer(row.column("z")[0].as_buffer(), complex).reshape(m, *mesh.shape(b, False)).real
                made = [([p[0] for p in some], [p[1] for p in some], z[(slice(None), *(p[2] for p in some))]) for some in itertools.product(*(wanted[d][b[d]] for d in range(nd)))]
                yield from _box_table(row, made, mesh).to_batches()

    kind = places.schema["point"].dataType.simpleString()
    placed, shares = _shares(places.select("field_id", "point", *(F.col(x).cast("double").alias(x) for x in xs)), mesh, ["point"])
    boxes = fine.select("field_id", *names, "z").mapInArrow(lent, _boxes(fine, mesh))
    keys = ["field_id", *names]
    boxes = boxes.join(shares, keys).select("*", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))

    def read(boxes: pa.Table, table: pa.Table) -> pa.Table:
        if not table.num_rows:
            at = np.zeros((m, 0))
        else:
            b = [table.column(n)[0].as_py() for n in names]
            grid_values = _assembled(boxes, mesh.shape(b, True), m).real.reshape(m, -1) if boxes.num_rows else np.zeros((m, int(np.prod(mesh.shape(b, True)))))
            at = np.concatenate([np.einsum("mpc,pc->mp", grid_values[:, flat], weight) for _, flat, weight in mesh.steps(table, b)], axis=1)
        take = pa.array(np.repeat(np.arange(table.num_rows), m))
        return pa.table({"field_id": table.column("field_id").take(take), "point": table.column("point").take(take), "c": pa.array(np.tile(np.array(components, np.int32), table.num_rows)), "value": at.T.ravel()})

    field = places.schema["field_id"].dataType.simpleString()
    return boxes.groupBy(*keys, "share").cogroup(placed.groupBy(*keys, "share")).applyInArrow(read, f"field_id {field}, point {kind}, c int, value double")
