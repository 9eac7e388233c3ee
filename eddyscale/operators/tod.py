"""Triadic orthogonal decomposition of time series.

Series rows (t, var, x, value[, value_im]) are cut into overlapping blocks of rows, each block
is tapered and transformed, and for every frequency triad k = n - l the products of k and l are
decomposed against n.

Places and triads are both cut.  Places come in blocks, each transformed in one task; what is kept
is a row of bytes for each frequency that triads use.  The (l, n) plane comes in square tiles: a
frequency goes to the tiles that use it, a row, a column and a diagonal band of them, not to each
triad.  A block of places and a tile meet in a task.

The decomposition over all places is that of their triangular factors: a block reduces the
receivers and products of a triad, side by side, to one small factor, factors combine ``FAN`` at a
time up a tree, and the root's core is decomposed.  Values, budgets and coefficients are the core's
alone; mode shapes come from a second pass over the blocks.  No task holds more than a block of
places or a few factors of a tile.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from . import modes as M


@dataclass(frozen=True)
class Parameters:
    """How a series of ``nt`` rows is cut: into blocks as long as ``window``, its taper's values."""

    nt: int
    window: np.ndarray
    noverlap: int
    dt: float

    def __post_init__(self):
        problems = {
            f"a window has four points at least, not {self.nfft}": self.nfft < 4,
            f"overlap {self.noverlap} must be from 0 to less than the window's {self.nfft}": not 0 <= self.noverlap < self.nfft,
        }
        problems |= {} if any(problems.values()) else {f"{self.nt} rows give {self.blocks} blocks; two are needed": self.blocks < 2}
        for text, holds in problems.items():
            if holds:
                raise ValueError(text)

    @property
    def nfft(self) -> int:
        return len(self.window)

    @property
    def hop(self) -> int:
        return self.nfft - self.noverlap

    @property
    def blocks(self) -> int:
        return (self.nt - self.noverlap) // self.hop


def default_window(nt: int) -> int:
    """The largest power of two up to a fifth of the rows, 256 at most."""
    return 1 << min(8, max(0, (nt // 5).bit_length() - 1))


def parameters(nt: int, window=None, noverlap: int | None = None, dt: float | None = None) -> Parameters:
    """``window``: a length, for a Hamming taper, or the taper's values; by default half of it overlaps and spans one unit of time."""
    if isinstance(window, (list, tuple, np.ndarray)):
        taper = np.asarray(window, float)
    elif window is None or isinstance(window, (int, np.integer)):
        n = default_window(nt) if window is None else int(window)
        taper = spectral.taper("hamming", n) if n > 1 else np.ones(1)
    else:
        raise TypeError("window: None, a length or the values")
    return Parameters(nt, taper, len(taper) // 2 if noverlap is None else int(noverlap), 1 / len(taper) if dt is None else float(dt))


class Result(NamedTuple):
    """bispectrum (l, n, mode, lambda, budget); modes (l, n, kind, mode, state, x, re, im) or None;
    coefficients (l, n, kind, mode, block, re, im) or None; frequencies, by centred index."""

    bispectrum: DataFrame
    modes: DataFrame | None
    coefficients: DataFrame | None
    frequencies: dict[int, float]


def block_starts(nt: int, p: Parameters) -> list[int]:
    """Hops of window less overlap; the last block ends with the series at the latest."""
    return [min(b * p.hop, nt - p.nfft) for b in range(p.blocks)]


def indices(n: int) -> list[int]:
    """Centred frequency indices, ascending."""
    return sorted(i if i < (n + 1) // 2 else i - n for i in range(n))


def triads(n: int, real: bool = True, nfreq: int | None = None) -> list[tuple[int, int, int]]:
    """(k, l, n) with k = n - l within bounds; for real series n is not negative."""
    own = indices(n)
    lo, hi = own[0], own[-1]
    if nfreq is not None and nfreq < hi:
        lo, hi = -nfreq, nfreq
    return [(b - a, a, b) for b in own for a in own if not (real and b < 0) and all(lo <= f <= hi for f in (b - a, a, b))]


#: Singular values up to this are cut.
LEAST = 100 * np.finfo(float).eps


#: Factors that meet in a node of the tree, numbers of a place block's series, numbers of a tile's factors, about.
FAN, BLOCK, TILE = 8, 1 << 22, 1 << 20


def factor(q_n: np.ndarray, q_kl: np.ndarray, root: np.ndarray) -> np.ndarray:
    """The square triangular factor of weighted receivers and products (row, block) side by side, zeros below."""
    both = np.hstack([q_n, q_kl]) * root[:, None]
    out = np.zeros((both.shape[1],) * 2, complex)
    r = np.linalg.qr(both, mode="r")
    out[: len(r)] = r
    return out


def merged(factors: list[np.ndarray]) -> np.ndarray:
    """One factor of each triad (triad, row, column) from several blocks'."""
    total = factors[0]
    for one in factors[1:]:
        total = np.linalg.qr(np.concatenate([total, one], axis=1), mode="r")
    return total


class Core(NamedTuple):
    """Of one triad: values, budgets, coefficients (mode, block), and what products and receivers are multiplied by to give the modes."""

    values: np.ndarray
    budget: np.ndarray
    convective: np.ndarray
    recipient: np.ndarray
    to_convective: np.ndarray
    to_recipient: np.ndarray


def core(r: np.ndarray, blocks: int, keep: int) -> Core:
    """Singular triplets of A B^H / blocks from the joint factor of receivers B and products A.

    In the basis of the factor B is its first columns and A its last, so that what is decomposed
    is no larger than twice the number of blocks, and no condition is squared.
    """
    b, a = r[:blocks, :blocks], r[:, blocks:]
    u, s, vh = np.linalg.svd(a @ b.conj().T / blocks, full_matrices=False)
    rank = min(int(np.count_nonzero(s > LEAST)), keep)
    u, s, v = u[:, :rank], s[:rank], vh[:rank].conj().T
    budget = s * (v.conj() * u[:blocks]).sum(0).real
    return Core(s, budget, u.conj().T @ a, v.conj().T @ b, b.conj().T @ v / (blocks * s), a.conj().T @ u / (blocks * s))


def triadic_svd(q_n: np.ndarray, q_kl: np.ndarray, weights: np.ndarray, blocks: int):
    """Modes of products and receivers (row, mode), without the weight, and singular values, of arrays (row, block) at hand."""
    found = core(factor(q_n, q_kl, np.sqrt(weights)), blocks, blocks)
    return q_kl @ found.to_convective, found.values, q_n @ found.to_recipient


def tiles(found: list[tuple[int, int, int]], edge: int) -> dict[int, list[tuple[int, int, int]]]:
    """Triads by tile of the (l, n) plane."""
    lo, out = min(min(b, c) for _, b, c in found), {}
    wide = (max(c for _, _, c in found) - lo) // edge + 1
    for k, a, n in found:
        out.setdefault((a - lo) // edge * wide + (n - lo) // edge, []).append((k, a, n))
    return out


def users(tiled: dict[int, list[tuple[int, int, int]]]) -> dict[int, list[int]]:
    """The tiles that use each frequency."""
    out: dict[int, set[int]] = {}
    for tile, own in tiled.items():
        for f in {f for triad in own for f in triad}:
            out.setdefault(f, set()).add(tile)
    return {f: sorted(t) for f, t in sorted(out.items())}


def _spectra(p: Parameters, nt: int, nvar: int, nx: int, places: int, used: list[int], kind: str, means):
    """Of a block of places: each frequency (var, place, block) as bytes."""
    starts, scale = block_starts(nt, p), 1 / p.window.mean() / p.nfft

    def run(table: pa.Table) -> pa.Table:
        xb = table.column("xb")[0].as_py()
        first, n = xb * places, min(places, nx - xb * places)
        x = np.zeros((nvar, n, nt), complex)
        at = (table.column("var").to_numpy(), table.column("x").to_numpy() - first, table.column("t").to_numpy())
        np.add.at(x, at, table.column("value").to_numpy() + 1j * table.column("value_im").to_numpy())
        if means is not None:
            x -= means.value[:, first : first + n, None]
        spectra = np.empty((len(used), nvar, n, p.blocks), complex)
        for b, start in enumerate(starts):
            cut = x[:, :, start : start + p.nfft]
            whole = np.fft.fft((cut - cut.mean(2, keepdims=True) if kind == "blockwise" else cut) * p.window, axis=2) * scale
            if kind == "blockwise":
                whole[:, :, 0] = (cut * p.window).sum(2) * scale
            for i, f in enumerate(used):
                spectra[i, :, :, b] = whole[:, :, f % p.nfft]
        return pa.table({"xb": pa.array([xb] * len(used), pa.int32()), "f": pa.array(used, pa.int32()), "z": pa.array([one.tobytes() for one in spectra], pa.binary())})

    return run


def _held(table: pa.Table, nvar: int, blocks: int) -> dict[int, np.ndarray]:
    return {f: np.frombuffer(z.as_buffer(), complex).reshape(nvar, -1, blocks) for f, z in zip(table.column("f").to_pylist(), table.column("z"), strict=True)}


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b


def tod(series: DataFrame, window=None, weight: list[float] | None = None, noverlap: int | None = None, dt: float | None = None, q=_product, lhs=None, nmode: int | None = None, nfreq: int | None = None, isreal_data: bool | None = None, mean_type="zero", return_coefficients: bool = False, return_auxiliary_modes: bool = False, outputs: tuple[str, ...] = ("bispectrum", "modes"), local: bool | None = None, places: int | None = None, edge: int | None = None) -> Result:
    """``q(k, l)`` and ``lhs(a)`` act on arrays (var, x, block); ``lhs`` may change the number of variables.

    ``mean_type``: zero, blockwise, or an array (var, x) to take off.  Auxiliary modes come with
    coefficients only.  ``outputs`` without "modes" leaves out the mode shapes, most of the result.
    ``local``: whether ``q`` and ``lhs`` take each place by itself, as the product does; if not, all
    places are one block.  ``places`` of a block and the tiles' ``edge`` follow from ``BLOCK`` and
    ``TILE`` otherwise.
    """
    spark = series.sparkSession
    if isinstance(mean_type, str) and mean_type not in ("zero", "blockwise"):
        raise ValueError(f"mean_type: {mean_type!r}")
    kind = mean_type if isinstance(mean_type, str) else "zero"
    missing = {"t", "var", "x", "value"} - set(series.columns)
    if missing:
        raise ValueError(f"series lack {sorted(missing)}")
    size = series.agg(*(F.max(c).alias(c) for c in ("t", "var", "x"))).first()
    if size["t"] is None:
        raise ValueError("an empty series")
    nt, nvar, nx = int(size["t"]) + 1, int(size["var"]) + 1, int(size["x"]) + 1
    real = "value_im" not in series.columns if isreal_data is None else isreal_data
    p = parameters(nt, window, noverlap, dt)
    if weight is not None and len(weight) != nx:
        raise ValueError(f"weight has {len(weight)} values for {nx} places")
    root = None if weight is None else spark.sparkContext.broadcast(np.sqrt(np.asarray(weight, float)))
    means = None if isinstance(mean_type, str) else spark.sparkContext.broadcast(np.asarray(mean_type, float).reshape(nvar, nx))
    keep, blocks = p.blocks if nmode is None else int(nmode), p.blocks
    act = lhs or (lambda a: a)
    states = len(act(np.zeros((nvar, nx if local is False else 1, 1), complex)))
    if not (local if local is not None else q is _product and lhs is None):
        places = nx
    shapes = "modes" in outputs
    edge = edge or min(16, max(1, math.isqrt(TILE // (4 * blocks * blocks))))
    # a task holds a block's series, or a tile's frequencies of it, or its modes
    places = min(nx, places or max(1, BLOCK // max(nvar * nt, 4 * edge * nvar * blocks, edge * edge * keep * states if shapes else 0)))
    count = -(-nx // places)
    tiled = tiles(triads(p.nfft, real, nfreq), edge)
    used = users(tiled)
    flat = lambda a: a.reshape(-1, blocks)
    weights = lambda xb, n: np.ones(states * n) if root is None else np.tile(root.value[xb * places : xb * places + n], states)

    im = F.col("value_im") if "value_im" in series.columns else F.lit(0.0)
    rows = series.select(F.floor(F.col("x") / places).cast("int").alias("xb"), *(F.col(c).cast("int").alias(c) for c in ("t", "var", "x")), F.col("value").cast("double").alias("value"), im.cast("double").alias("value_im"))
    spectra = rows.groupBy("xb").applyInArrow(_spectra(p, nt, nvar, nx, places, list(used), kind, means), "xb int, f int, z binary")
    # each frequency goes to the tiles that use it
    goes = F.array(*(F.array(*map(F.lit, used.get(f, []))).cast("array<int>") for f in range(min(used), max(used) + 1)))
    spectra = spectra.select("xb", F.explode(F.get(goes, F.col("f") - min(used))).alias("tile"), "f", "z")
    if shapes:
        spectra = M.once(spectra)  # read by both passes

    def reduced(table: pa.Table) -> pa.Table:
        xb, tile, held = table.column("xb")[0].as_py(), table.column("tile")[0].as_py(), _held(table, nvar, blocks)
        own = weights(xb, next(iter(held.values())).shape[1])
        made = np.stack([factor(flat(act(held[n])), flat(q(held[k], held[a])), own) for k, a, n in tiled[tile]])
        return pa.table({"tile": pa.array([tile], pa.int32()), "xb": pa.array([xb], pa.int32()), "r": pa.array([made.tobytes()], pa.binary())})

    def combined(table: pa.Table) -> pa.Table:
        tile = table.column("tile")[0].as_py()
        made = merged([np.frombuffer(r.as_buffer(), complex).reshape(len(tiled[tile]), 2 * blocks, 2 * blocks) for r in table.column("r")])
        return pa.table({"tile": pa.array([tile], pa.int32()), "xb": table.column("xb").slice(0, 1), "r": pa.array([made.tobytes()], pa.binary())})

    factors = spectra.groupBy("xb", "tile").applyInArrow(reduced, "tile int, xb int, r binary")
    left = count
    while left > 1:
        factors = factors.withColumn("xb", F.floor(F.col("xb") / FAN).cast("int")).groupBy("tile", "xb").applyInArrow(combined, "tile int, xb int, r binary")
        left = -(-left // FAN)

    numbers = ["lambda", "budget", *(f"a_{x}_{y}" for x in ("convective", "recipient") for y in ("re", "im"))]

    def decomposed(batches):
        for batch in batches:
            for tile, r in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                whole = np.frombuffer(r.as_buffer(), complex).reshape(-1, 2 * blocks, 2 * blocks)
                found = [core(one, blocks, keep) for one in whole]
                lists = [[c.values for c in found], [c.budget for c in found]]
                lists += [[part(x).ravel() for x in side] for side in ([c.convective for c in found], [c.recipient for c in found]) for part in (np.real, np.imag)]
                w = [np.concatenate([c.to_convective, c.to_recipient, c.recipient.conj().T / c.values / blocks]).tobytes() if shapes else b"" for c in found]
                head = [pa.array([tile] * len(found), pa.int32()), pa.array([t[1] for t in tiled[tile]], pa.int32()), pa.array([t[2] for t in tiled[tile]], pa.int32())]
                yield pa.RecordBatch.from_arrays([*head, *(pa.array(x, pa.list_(pa.float64())) for x in lists), pa.array(w, pa.binary())], names=["tile", "l", "n", *numbers, "w"])

    got = factors.select("tile", "r").mapInArrow(decomposed, "tile int, l int, n int, " + ", ".join(f"`{a}` array<double>" for a in numbers) + ", w binary")
    if shapes or return_coefficients:
        got = M.once(got)  # one row a triad, read once for each output
    bispectrum = got.select("l", "n", F.posexplode(F.arrays_zip("lambda", "budget")).alias("mode", "z")).select("l", "n", "mode", "z.lambda", "z.budget")
    coefficients = None
    for name in ("convective", "recipient") if return_coefficients else ():
        one = got.select("l", "n", F.posexplode(F.arrays_zip(F.col(f"a_{name}_re").alias("re"), F.col(f"a_{name}_im").alias("im"))).alias("at", "z"))
        one = one.select("l", "n", F.lit(name).alias("kind"), F.floor(F.col("at") / blocks).cast("int").alias("mode"), (F.col("at") % blocks).cast("int").alias("block"), "z.re", "z.im")
        coefficients = one if coefficients is None else coefficients.unionByName(one)
    modes = None
    if shapes:
        names = ["convective", "recipient"] + (["donor", "catalyst"] if return_coefficients and return_auxiliary_modes else [])

        def shaped(cores: pa.Table, table: pa.Table) -> pa.Table:
            xb = cores.column("xb")[0].as_py()
            n = min(places, nx - xb * places)
            held = _held(table, nvar, blocks)
            zero = np.zeros((nvar, n, blocks), complex)  # a block without any row
            take = lambda f: held.get(f, zero)
            out = []
            for a, end, w in zip(cores.column("l").to_pylist(), cores.column("n").to_pylist(), cores.column("w"), strict=True):
                to = np.frombuffer(w.as_buffer(), complex).reshape(3, blocks, -1)
                k = end - a
                sides = {"convective": (lambda k=k, a=a: q(take(k), take(a)), 0), "recipient": (lambda e=end: act(take(e)), 1), "donor": (lambda a=a: act(take(a)), 2), "catalyst": (lambda k=k: act(take(k)), 2)}
                for name in names:
                    made, i = sides[name]
                    z = (flat(made()) @ to[i]).T  # (mode, row)
                    mode, state, x = np.indices((len(z), states, n), np.int32).reshape(3, -1)
                    out.append(pa.table({"l": np.full(z.size, a, np.int32), "n": np.full(z.size, end, np.int32), "kind": pa.repeat(name, z.size), "mode": mode, "state": state, "x": x + np.int32(xb * places), "re": z.real.ravel(), "im": z.imag.ravel()}))
            return pa.concat_tables(out)

        each = got.select("tile", "l", "n", "w", F.explode(F.sequence(F.lit(0), F.lit(count - 1))).alias("xb"))
        modes = each.groupBy("xb", "tile").cogroup(spectra.groupBy("xb", "tile")).applyInArrow(shaped, "l int, n int, kind string, mode int, state int, x int, re double, im double")
    return Result(bispectrum, modes, coefficients, {f: f / (p.dt * p.nfft) for f in indices(p.nfft)})


def windowed_dft(series: DataFrame, nt: int, p: Parameters, wanted: list[int] | None = None) -> DataFrame:
    """(var, x, block, f, re, im) by joins alone: rows meet the blocks that hold them, and each frequency."""
    starts = block_starts(nt, p)
    taper = F.array(*map(F.lit, map(float, p.window)))
    blocks = F.filter(F.array(*(F.struct(F.lit(b).alias("b"), F.lit(s).alias("s")) for b, s in enumerate(starts))), lambda z: (F.col("t") >= z["s"]) & (F.col("t") < z["s"] + p.nfft))
    cut = series.select("var", "x", "t", "value", F.explode(blocks).alias("z"))
    cut = cut.select("var", "x", F.col("z.b").alias("block"), (F.col("t") - F.col("z.s")).alias("j"), "value")
    cut = cut.select("*", F.explode(F.array(*map(F.lit, wanted or indices(p.nfft)))).alias("f"))
    angle = F.col("f") * F.col("j") * (2 * math.pi / p.nfft)
    z = F.col("value") * F.element_at(taper, (F.col("j") + 1).cast("int")) / float(p.window.mean() * p.nfft)
    return cut.groupBy("var", "x", "block", "f").agg(F.sum(z * F.cos(angle)).alias("re"), (-F.sum(z * F.sin(angle))).alias("im"))
