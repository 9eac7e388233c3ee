"""Whitening of embeddings: principal components of equal variance, by a two-pass covariance.

1.  Entries become whole numbers, floor(64 c) + 1000000.  Each task sums its vectors, exactly; sums
    meet in a tree of partial sums (treeAggregate), which gives the mean without any rounding but
    that of one division.
2.  Each task sums the outer products of its centred vectors by a matrix product a batch; these meet
    in a tree as well.  LAPACK's symmetric eigensolver takes the covariance apart on the driver.
3.  The mean and the components go to all tasks, which project their vectors.  The covariance of
    what they give is measured the same way, in a pass of its own.

Scale: three maps over the vectors, no shuffle of rows; what moves is d^2 numbers a task, up a tree.
A task holds a batch of vectors and d^2 sums, whatever the number of rows.

Defined results: vectors that are null, empty or hold nulls, infinities or NaN are left out, and so
are those whose length isn't the most frequent one (of equally frequent ones, the longest); repeated
rows and null ids count each; equal eigenvalues keep the solver's order.  Components without
variance (eigenvalue up to d times the rounding unit of the largest) can't be whitened and give no
rows, so a table of one vector, or of copies of one, gives none; an empty table gives none either.
Sums are Python's whole numbers where 64 bits might not hold them; ``deviation`` is null where its
value doesn't fit in a long.  Only ``vec_id`` and ``embedding`` are read, so other columns may have
any name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces, quoted

STEP, SHIFT = 64.0, 1_000_000
#: Rows of a batch in which outer products are summed.
_ROWS = 4096


@dataclass(frozen=True)
class Whitening:
    """Number of vectors, their exact sums, eigenvalues (falling), components (columns, over the root of their value), share of variance."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    projection: np.ndarray
    explained: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector, as doubles, is whole: (.., v, d)."""
    v = F.col(quoted(column)).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embeddings.where((F.size(v) > 0) & finite).withColumn("v", v)


def dimension(vectors: DataFrame) -> int:
    """The most frequent length; of equally frequent ones the longest."""
    row = vectors.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return row["d"] if row else 0


def whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    """(row, entry): floor(64 c) + 1000000, as 64-bit numbers, or Python's where those might not do."""
    column = batch.column(batch.schema.get_field_index("v"))
    y = np.floor(STEP * column.flatten().to_numpy(zero_copy_only=False)).reshape(-1, d)
    if not len(y) or np.abs(y).max() < 1 << 52:
        return y.astype(np.int64) + SHIFT
    return np.array([[int(z) + SHIFT for z in row] if np.isfinite(row).all() else [_floor(c) + SHIFT for c in own] for row, own in zip(y.tolist(), column.to_pylist(), strict=True)], object)


def _floor(c: float) -> int:
    """floor(64 c) where the product leaves the doubles."""
    top, bottom = c.as_integer_ratio()
    return int(STEP) * top // bottom


def _folded(vectors: DataFrame, part, schema: str, columns: list[str]) -> list:
    """Tasks' rows of sums, added up entry by entry in a tree."""
    rows = vectors.select("v").mapInArrow(part, schema).rdd.map(lambda r: [[np.asarray(r[c], object if c == "sums" else float), r["n"]] for c in columns])
    add = lambda a, b: b if a is None else a if b is None else [[x + y, m + n] for (x, m), (y, n) in zip(a, b, strict=True)]
    return rows.treeAggregate(None, add, add, depth=3)


def _summed(d: int):
    """Exact sums as text, since they may be longer than a long."""

    def run(batches):
        n, total = 0, [0] * d
        for batch in pieces(batches, rows=_ROWS):
            x = whole(batch, d)
            n += len(x)
            own = x.sum(0, dtype=object) if x.dtype == object or np.abs(x).max(initial=0) >= 1 << 50 else x.sum(0)
            total = [a + int(b) for a, b in zip(total, own, strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(t) for t in total]], pa.list_(pa.string()))], names=["n", "sums"])

    return run


def centred(x: np.ndarray, mean: np.ndarray) -> np.ndarray:
    return x.astype(float) - mean


def _products(d: int, mean: np.ndarray, projection: np.ndarray | None = None):
    """Sums of outer products of centred vectors, or of what they are projected on."""

    def run(batches):
        total, n = 0.0, 0
        for batch in pieces(batches, rows=_ROWS):
            y = centred(whole(batch, d), mean)
            y = y if projection is None else y @ projection
            total, n = total + y.T @ y, n + len(y)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))], names=["n", "products"])

    return run


def fit(vectors: DataFrame, most: int = 32) -> Whitening | None:
    """Components of the vectors ``v`` of ``usable``; None without any vector."""
    if not (d := dimension(vectors)):
        return None
    own = vectors.where(F.size("v") == d)
    rows = own.select("v").mapInArrow(_summed(d), "n long, sums array<string>").rdd.map(lambda r: (r["n"], [int(s) for s in r["sums"]]))
    add = lambda a, b: (a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)])
    n, sums = rows.treeAggregate((0, [0] * d), add, add, depth=3)
    mean = np.array([s / n for s in sums])
    [[products, _]] = _folded(own, _products(d, mean), "n long, products array<double>", ["products"])
    covariance = products.reshape(d, d) / n
    values, components = np.linalg.eigh((covariance + covariance.T) / 2)
    values, components = values[::-1], components[:, ::-1]
    trace = float(np.trace(covariance))
    there = int(np.count_nonzero(values[:most] > max(values[0], 0.0) * d * np.finfo(float).eps)) if trace > 0 else 0
    values, components = values[:there], components[:, :there]
    return Whitening(n, tuple(sums), values, components / np.sqrt(values), values / trace if there else values)


def identity_error(vectors: DataFrame, found: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance less the identity, measured over all of them."""
    d, k = len(found.sums), len(found.values)
    [[products, n]] = _folded(vectors.where(F.size("v") == d), _products(d, found.mean, found.projection), "n long, products array<double>", ["products"])
    return float(np.abs(products.reshape(k, k) / n - np.eye(k)).max())


def _deviation(x: np.ndarray, n: int, sums: tuple[int, ...]) -> list[int | None]:
    """Sum of (n x - S)^2, exactly; None beyond a long."""
    top = max(float(np.abs(x.astype(float)).max(initial=0)) * n, max(map(abs, sums)))
    if x.dtype != object and top < 1 << 61:
        off = n * x - np.array(sums, np.int64)
        if (off.astype(float) ** 2).sum(1).max(initial=0) < 1 << 62:
            return (off * off).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x.tolist()]
    return [e if e < 1 << 63 else None for e in exact]


def whitened(vectors: DataFrame, found: Whitening, key: str = "vec_id") -> DataFrame:
    """(key, deviation long, whitened array<double>) of each vector."""
    shared = vectors.sparkSession.sparkContext.broadcast((found.n, found.sums, found.mean, found.projection))
    d, k = len(found.sums), len(found.values)
    kind = vectors.schema[key].dataType.simpleString()

    def run(batches):
        n, sums, mean, projection = shared.value
        for batch in pieces(batches, rows=_ROWS):
            x = whole(batch, d)
            y = centred(x, mean) @ projection
            ends = pa.array(np.arange(len(y) + 1) * k, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_deviation(x, n, sums), pa.int64()), pa.ListArray.from_arrays(ends, pa.array(y.ravel()))], names=["key", "deviation", "whitened"])

    own = vectors.where(F.size("v") == d).select(F.col(quoted(key)).alias("key"), "v")
    return own.mapInArrow(run, f"key {kind}, deviation long, whitened array<double>").withColumnRenamed("key", key)


def report(embeddings: DataFrame, most: int = 32) -> DataFrame:
    """The contract's row of each vector and component."""
    vectors = usable(embeddings.select("vec_id", "embedding")).select("vec_id", "v")
    found = fit(vectors, most)
    if found is None or not len(found.values):
        kind = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(vectors, found)
    explained = F.element_at(F.array(*map(F.lit, map(float, found.explained))), F.col("component"))
    rows = whitened(vectors, found).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).withColumn("component", F.col("at") + 1)
    return rows.select("vec_id", "component", F.lit(found.n).cast("long").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(error).alias("identity_error"))
