"""Divergent and rotational parts of a velocity on a grid with dry cells.

Finite volumes: a flow goes through the open faces, those between two wet cells.  The divergent part
is the difference of a potential over each open face, the one nearest to the flow in the mean
square; the rest is rotational.  So the rotational part has no divergence in any wet cell and none
of it goes through a wall, and the divergent part has no circulation around any loop of wet cells.

The potential solves the wet cells' Laplace equation, by conjugate gradients with the inverse of the
whole periodic grid's Laplacian in front, which keeps the number of steps low whatever the grid's
size.  A field that a task can hold is solved there, without a shuffle after that which packs it.  A
larger one is cut into blocks (``pencil``).  A step is then one written table: blocks get their
field's sums by a join, go through the transforms an axis at a time, and trade their outermost cells
with their neighbours; that is 2 nd shuffles, and a task holds a pencil.  Both sums that a step
needs come from one pass, so no step waits twice.  The tables lie in the folder that
``spark.checkpoint.dir`` names, the last two of them at any time, so a lost executor costs a part of
one step.

Defined results: a missing cell, or one whose flag or any component is null or not finite, is dry;
rows of one place and component are summed; faces that aren't open have 0 in both parts; wet cells
without an open face, fields without a wet cell and empty tables are no error.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.types import Grid
from . import modes as M
from . import pencil

_STATE = "z binary, flags binary, g double, d double, rr double, bb double, gamma double, alpha double"


@lru_cache(maxsize=1)
def _own_folder() -> str:
    return "file://" + tempfile.mkdtemp(prefix="steps-")


class Steps:
    """Written tables, of which ``drop`` deletes the ones that are no longer read."""

    def __init__(self, spark: SparkSession):
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        self.spark, self.root = spark, f"{(shared or _own_folder()).rstrip('/')}/steps-{uuid.uuid4().hex[:12]}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


class Halo:
    """Blocks of real numbers and their neighbours' outermost cells."""

    def __init__(self, grid: Grid, cut: pencil.Cut, kind: str):
        self.grid, self.cut, self.keys = grid, cut, ["field_id", *cut.names]
        self.place = f"field_id {kind}, {', '.join(f'{b} int' for b in cut.names)}"

    def shape(self, b: list[int]) -> tuple[int, ...]:
        edges = [self.cut.block(d, n, b[d]) for d, n in enumerate(self.grid.ns)]
        return tuple(s.stop - s.start for s in edges)

    def at(self, table, row: int = 0) -> list[int]:
        return [table.column(n)[row].as_py() for n in self.cut.names]

    def sent(self, df: DataFrame) -> DataFrame:
        """Rows ``slot`` and ``z`` by receiving block: 0 its own numbers, 1 + 2 d those before it along d, 2 + 2 d those after it."""
        nd, parts = self.grid.nd, self.cut.parts

        def run(batches):
            for batch in batches:
                for row in range(batch.num_rows):
                    b = self.at(batch, row)
                    z = np.frombuffer(batch.column(nd + 1)[row].as_buffer(), complex).real.reshape(-1, *self.shape(b))
                    out = [(b, 0, z)]
                    for d in range(nd):
                        to = lambda step, d=d: [(x + step) % parts[d] if e == d else x for e, x in enumerate(b)]
                        out += [(to(1), 1 + 2 * d, z.take([-1], d + 1)), (to(-1), 2 + 2 * d, z.take([0], d + 1))]
                    field = batch.column(0).take(pa.array([row] * len(out)))
                    places = [pa.array([o[0][d] for o in out], pa.int32()) for d in range(nd)]
                    yield pa.RecordBatch.from_arrays([field, *places, pa.array([o[1] for o in out], pa.int32()), pa.array([np.ascontiguousarray(o[2]).tobytes() for o in out], pa.binary())], names=[*self.keys, "slot", "z"])

        return df.select(*self.keys, "z").mapInArrow(run, f"{self.place}, slot int, z binary")

    def received(self, rows: pa.Table, b: list[int], channels: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """A block's own numbers, and along each axis those of the cells before and after each cell; what is missing is 0."""
        shape = self.shape(b)
        got = {s: np.frombuffer(z.as_buffer()).reshape(channels, -1) for s, z in zip(rows.column("slot").to_pylist(), rows.column("z"), strict=True)}
        own = got[0].reshape(channels, *shape) if 0 in got else np.zeros((channels, *shape))
        before, after = [], []
        for d in range(len(shape)):
            rim = (channels, *(1 if e == d else n for e, n in enumerate(shape)))
            first, last = (got[s].reshape(rim) if s in got else np.zeros(rim) for s in (1 + 2 * d, 2 + 2 * d))
            wide = np.concatenate([first, own, last], axis=d + 1)
            before.append(wide.take(range(shape[d]), d + 1))
            after.append(wide.take(range(2, shape[d] + 2), d + 1))
        return own, before, after


def _open(flags: np.ndarray, d: int, after: bool) -> np.ndarray:
    return (flags >> (1 + 2 * d + after)) & 1


def _blocks(points: DataFrame, grid: Grid, cut: pencil.Cut) -> DataFrame:
    """Components, and how many of them each cell has if it is wet."""
    nd, value = grid.nd, F.col("value").cast("double")
    sound = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    wet = F.coalesce(F.col("wet"), F.lit(False)) if "wet" in points.columns else F.lit(True)
    good = F.coalesce(sound, F.lit(False)) & wet
    pair = F.array(F.struct(F.col("c").cast("int").alias("c"), F.when(good, value).otherwise(0.0).alias("value")), F.struct(F.lit(nd).alias("c"), good.cast("double").alias("value")))
    rows = points.where((F.col("c") >= 0) & (F.col("c") < nd)).select(*M.place(grid), F.explode(pair).alias("p")).select(*M.place(grid), "p.c", "p.value")
    return pencil.blocks(rows, grid, nd + 1, cut, ("value",))


def helmholtz(points: DataFrame, grid: Grid, spacing: tuple[float, ...] | None = None, centred: bool = True, tolerance: float = 1e-12, most: int = 1000, parts: int | tuple[int, ...] | None = None) -> DataFrame:
    """field_id, component (divergent, rotational), i0.., c, value, of long points with a column ``wet``; without it all are wet.

    Value c of a cell belongs to the face between it and the next cell along axis c.  ``centred``
    velocities belong to cells, and the mean of both cells goes through a face; others are face values
    already.  ``spacing``: cell lengths, those of the grid unless given.  The equation is
    solved until no field's residual is over ``tolerance`` of its right-hand side; more than ``most`` steps
    are an error.
    """
    nd = grid.nd
    h = tuple(float(x) for x in spacing or (a / n for a, n in zip(grid.lengths, grid.ns, strict=True)))
    if len(h) != nd or min(h) <= 0:
        raise ValueError("one positive cell length for each axis")
    cut = pencil.cut_of(grid, 2 * nd + 4, parts)
    halo = Halo(grid, cut, points.schema["field_id"].dataType.simpleString())
    faces = _faces(_blocks(points, grid, cut), grid, halo, h, centred)
    if math.prod(cut.parts) == 1:
        return _long(_whole(faces, grid, halo, h, tolerance, most), grid, cut)
    steps = Steps(points.sparkSession)
    faces = steps.write(faces, "faces")
    state = steps.write(_preconditioned(faces.select(*halo.keys, *(c.split()[0] for c in _STATE.split(", "))), grid, cut, halo, h), "step-0")
    for k in range(most + 1):
        if k % 4 and k < most:
            state = _next(steps, state, k, grid, cut, halo, h, tolerance)
            continue
        left = state.groupBy("field_id").agg(F.sum("rr").alias("rr"), F.sum("bb").alias("bb"))
        if not left.where(F.col("rr") > tolerance**2 * F.col("bb")).limit(1).count():
            break
        if k == most:
            raise ArithmeticError(f"no solution within {most} steps")
        state = _next(steps, state, k, grid, cut, halo, h, tolerance)
    return _long(_parts(faces, state, grid, halo, h), grid, cut)


def _next(steps: Steps, state: DataFrame, k: int, grid: Grid, cut: pencil.Cut, halo: Halo, h: tuple[float, ...], tolerance: float) -> DataFrame:
    state = steps.write(_preconditioned(_advanced(state, halo, tolerance), grid, cut, halo, h), f"step-{k + 1}")
    if k:
        steps.drop(f"step-{k - 1}")
    return state


def _long(blocks: DataFrame, grid: Grid, cut: pencil.Cut) -> DataFrame:
    nd = grid.nd
    name = F.when(F.col("c") < nd, F.lit("divergent")).otherwise(F.lit("rotational"))
    return pencil.unblock(blocks, grid, cut, ("re",)).select("field_id", name.alias("component"), *M.place(grid)[1:], (F.col("c") % nd).cast("int").alias("c"), F.col("re").alias("value"))


def _symbol(grid: Grid, h: tuple[float, ...], where: tuple[slice, ...]) -> np.ndarray:
    """The whole periodic grid's Laplacian on some modes; the mean, which has no inverse, gets the least other value."""
    each = [(2 - 2 * np.cos(2 * np.pi * np.arange(n) / n)) / a**2 for n, a in zip(grid.ns, h, strict=True)]
    least = min((float(v[1]) for v in each if len(v) > 1), default=1.0)
    of = sum(np.meshgrid(*(v[w] for v, w in zip(each, where, strict=True)), indexing="ij"))
    return np.where(of > least / 2, of, least)


def _image(m: np.ndarray, before: list[np.ndarray], after: list[np.ndarray], flags: np.ndarray, h: tuple[float, ...]) -> np.ndarray:
    """What flows out of each wet cell if ``m`` is the potential."""
    return sum((_open(flags, d, False) * (m - before[d]) + _open(flags, d, True) * (m - after[d])) / h[d] ** 2 for d in range(m.ndim))


def _slopes(x: np.ndarray, after: list[np.ndarray], flags: np.ndarray, h: tuple[float, ...]) -> np.ndarray:
    return np.stack([_open(flags, d, True) * (after[d] - x) / h[d] for d in range(x.ndim)])


def _whole(faces: DataFrame, grid: Grid, halo: Halo, h: tuple[float, ...], tolerance: float, most: int) -> DataFrame:
    """Both parts of fields that are one block each."""
    nd = grid.nd
    around = lambda m, step: [np.roll(m, step, d) for d in range(nd)]
    symbol = _symbol(grid, h, (slice(None),) * nd)

    def potential(r: np.ndarray, flags: np.ndarray) -> np.ndarray:
        x, p, gamma, bb = np.zeros(r.shape), np.zeros(r.shape), None, float((r**2).sum())
        for _ in range(most):
            if float((r**2).sum()) <= tolerance**2 * bb:
                return x
            z = np.fft.ifftn(np.fft.fftn(r) / symbol).real * (flags & 1)
            product = float((r * z).sum())
            p = z + (product / gamma if gamma else 0.0) * p
            image, gamma = _image(p, around(p, 1), around(p, -1), flags, h), product
            step = product / float((p * image).sum())
            x, r = x + step * p, r - step * image
        raise ArithmeticError(f"no solution within {most} steps")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(row, 1)])
                flags = np.frombuffer(one.column("flags")[0].as_buffer(), np.uint8).reshape(grid.ns)
                face = np.frombuffer(one.column("face")[0].as_buffer()).reshape(nd, *grid.ns)
                x = potential(np.frombuffer(one.column("z")[0].as_buffer()).reshape(6, *grid.ns)[1], flags)
                slope = _slopes(x, around(x, -1), flags, h)
                z = np.concatenate([slope, face - slope]).astype(complex)
                yield from one.select(halo.keys).append_column("z", pa.array([z.tobytes()], pa.binary())).to_batches()

    return faces.select(*halo.keys, "flags", "face", "z").mapInArrow(run, f"{halo.place}, z binary")


def _faces(blocks: DataFrame, grid: Grid, halo: Halo, h: tuple[float, ...], centred: bool) -> DataFrame:
    """A block's face values, open faces as bits, and the first residual: what flows in."""
    nd = grid.nd

    def run(table: pa.Table) -> pa.Table:
        b = halo.at(table)
        own, before, after = halo.received(table, b, nd + 1)
        if not (table.column("slot").to_numpy() == 0).any():
            return _state_rows(table, [], halo)
        wet = own[nd] >= nd
        flags, into, face = wet.astype(np.uint8), np.zeros(wet.shape), np.zeros((nd, *wet.shape))
        for d in range(nd):
            for side, other in ((0, before[d]), (1, after[d])):
                there = wet & (other[nd] >= nd)
                flags |= (there.astype(np.uint8) << (1 + 2 * d + side)).astype(np.uint8)
                v = (own[d] + other[d]) / 2 if centred else (own[d] if side else other[d])
                v = np.where(there, v, 0.0)
                into += (-v if side else v) / h[d]
                if side:
                    face[d] = v
        z = np.concatenate([np.zeros((1, *wet.shape)), into[None], np.zeros((4, *wet.shape))])
        rr = float((into**2).sum())
        return _state_rows(table, [(z, flags, 0.0, 0.0, rr, rr, None, None, face)], halo)

    return halo.sent(blocks).groupBy(*halo.keys).applyInArrow(run, f"{halo.place}, {_STATE}, face binary")


def _state_rows(table: pa.Table, made: list[tuple], halo: Halo) -> pa.Table:
    """Rows of one block; a ninth value is its faces."""
    place = table.select(halo.keys).slice(0, len(made))
    names = ["z", "flags", "g", "d", "rr", "bb", "gamma", "alpha", "face"]
    kinds = [pa.binary(), pa.binary(), *[pa.float64()] * 6, pa.binary()]
    width = 9 if not made else len(made[0])
    for n, (name, kind) in enumerate(zip(names[:width], kinds, strict=False)):
        own = [m[n].tobytes() if isinstance(m[n], np.ndarray) else m[n] for m in made]
        place = place.append_column(name, pa.array(own, kind))
    return place


def _advanced(state: DataFrame, halo: Halo, tolerance: float) -> DataFrame:
    """Potential, residual and directions one step on; a field that is solved stays as it is.

    Channels are potential, residual, direction, its image, preconditioned residual, its image.
    """
    sums = state.groupBy(F.col("field_id").alias("of")).agg(F.sum("g").alias("gs"), F.sum("d").alias("ds"), F.max("gamma").alias("g0"), F.max("alpha").alias("a0"), F.sum("rr").alias("rs"), F.sum("bb").alias("bs"))
    over = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    sums = sums.withColumn("beta", F.coalesce(over(F.col("gs"), F.col("g0")), F.lit(0.0)))
    sums = sums.withColumn("step", over(F.col("gs"), F.col("ds") - F.coalesce(F.col("beta") * over(F.col("gs"), F.col("a0")), F.lit(0.0))))
    solved = F.col("rs") <= tolerance**2 * F.col("bs")
    sums = sums.withColumns({c: F.when(solved, 0.0).otherwise(F.col(c)) for c in ("beta", "step")})
    rows = state.join(sums, F.col("field_id").eqNullSafe(F.col("of"))).select(*halo.keys, "z", "flags", "bb", "gs", "step", "beta")

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(row, 1)])
                bb, gs, step, beta = (one.column(n)[0].as_py() for n in ("bb", "gs", "step", "beta"))
                x, r, p, s, z, w = np.frombuffer(one.column("z")[0].as_buffer()).reshape(6, -1)
                p, s = z + beta * p, w + beta * s
                x, r = x + step * p, r - step * s
                out = np.stack([x, r, p, s, z, w])
                flags = np.frombuffer(one.column("flags")[0].as_buffer(), np.uint8)
                yield from _state_rows(one, [(out, flags, 0.0, 0.0, float(r @ r), bb, gs, step)], halo).to_batches()

    return rows.mapInArrow(run, f"{halo.place}, {_STATE}")


def _preconditioned(state: DataFrame, grid: Grid, cut: pencil.Cut, halo: Halo, h: tuple[float, ...]) -> DataFrame:
    """The state with the preconditioned residual, its image and both products of them with the residual."""
    nd, ns = grid.nd, grid.ns

    def residual(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(row, 1)])
                r = np.frombuffer(one.column("z")[0].as_buffer()).reshape(6, -1)[1]
                yield from one.select(halo.keys).append_column("z", pa.array([r.astype(complex).tobytes()], pa.binary())).to_batches()

    def forth(x, where, d):
        x = np.fft.fft(x, axis=d + 1)
        if d < nd - 1:
            return x
        return np.fft.ifft(x / _symbol(grid, h, tuple(where)), axis=d + 1)

    rows = state.select(*halo.keys, "z").mapInArrow(residual, f"{halo.place}, z binary")
    for d in range(nd):
        rows = pencil.along(rows, cut, ns, d, lambda x, w, d=d: forth(x, w, d), ns[d])
    for d in range(nd - 2, -1, -1):
        rows = pencil.along(rows, cut, ns, d, lambda x, _, d=d: np.fft.ifft(x, axis=d + 1), ns[d])

    def run(own: pa.Table, sent: pa.Table) -> pa.Table:
        if not own.num_rows:
            return _state_rows(own, [], halo).drop(["face"])
        b = halo.at(own)
        got, before, after = halo.received(sent, b, 1)
        z = np.frombuffer(own.column("z")[0].as_buffer()).reshape(6, -1)
        flags = np.frombuffer(own.column("flags")[0].as_buffer(), np.uint8).reshape(halo.shape(b))
        m = got[0] * (flags & 1)
        image = _image(m, [x[0] for x in before], [x[0] for x in after], flags, h)
        m, image = m.ravel(), image.ravel()
        out = np.concatenate([z[:4], m[None], image[None]])
        kept = [own.column(n)[0].as_py() for n in ("rr", "bb", "gamma", "alpha")]
        return _state_rows(own, [(out, flags, float(z[1] @ m), float(image @ m), *kept)], halo)

    return state.groupBy(*halo.keys).cogroup(halo.sent(rows).groupBy(*halo.keys)).applyInArrow(run, f"{halo.place}, {_STATE}")


def _parts(faces: DataFrame, state: DataFrame, grid: Grid, halo: Halo, h: tuple[float, ...]) -> DataFrame:
    nd = grid.nd

    def potential(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                one = pa.Table.from_batches([batch.slice(row, 1)])
                x = np.frombuffer(one.column("z")[0].as_buffer()).reshape(6, -1)[0]
                yield from one.select(halo.keys).append_column("z", pa.array([x.astype(complex).tobytes()], pa.binary())).to_batches()

    def run(own: pa.Table, sent: pa.Table) -> pa.Table:
        rows = own.select(halo.keys)
        if not own.num_rows:
            return rows.append_column("z", pa.array([], pa.binary()))
        b = halo.at(own)
        x, _, after = halo.received(sent, b, 1)
        flags = np.frombuffer(own.column("flags")[0].as_buffer(), np.uint8).reshape(halo.shape(b))
        face = np.frombuffer(own.column("face")[0].as_buffer()).reshape(nd, *halo.shape(b))
        slope = _slopes(x[0], [y[0] for y in after], flags, h)
        z = np.concatenate([slope, face - slope]).astype(complex)
        return rows.append_column("z", pa.array([z.tobytes()], pa.binary()))

    sent = halo.sent(state.select(*halo.keys, "z").mapInArrow(potential, f"{halo.place}, z binary"))
    return faces.select(*halo.keys, "flags", "face").groupBy(*halo.keys).cogroup(sent.groupBy(*halo.keys)).applyInArrow(run, f"{halo.place}, z binary")
