"""Long and wide forms of spectral fields.

Long: field_id, i0..i2, c, re, im, a row for each mode and component; missing modes are zero.
Wide: a row for each mode with columns r0, m0, r1, m1.. for the components.  Further key
columns (a component's name, a giver's shell) travel along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import Grid

MODES = "field_id string, i0 int, i1 int, i2 int, c int, re double, im double"
POINTS = "field_id string, x0 double, x1 double, x2 double, c int, value double"
IDS = ["i0", "i1", "i2"]


def place(grid: Grid) -> list[str]:
    return ["field_id", *IDS[: grid.nd]]


def negated(grid: Grid, d: int, prefix: str = "i") -> Column:
    n = grid.ns[d]
    return ((n - spectral.index(d, prefix)) % n).cast("int")


def validate(modes: DataFrame, grid: Grid, vector: bool = False) -> None:
    """Columns, index ranges and, for a vector, a component for each axis; one small aggregate."""
    missing = {"field_id", *IDS[: grid.nd], "c", "re", "im"} - set(modes.columns)
    if missing:
        raise ValueError(f"modes lack {sorted(missing)}")
    stats = modes.agg(*(F.max(c).alias(c) for c in [*IDS[: grid.nd], "c"]), *(F.min(c).alias(f"lo_{c}") for c in IDS[: grid.nd])).first()
    for d, n in enumerate(grid.ns):
        if stats[f"i{d}"] is not None and not (0 <= stats[f"lo_i{d}"] and stats[f"i{d}"] < n):
            raise ValueError(f"index i{d} outside 0..{n - 1}")
    if vector and (stats["c"] is None or stats["c"] + 1 < grid.nd):
        raise ValueError(f"a velocity has {grid.nd} components at least")


def as_component_field(modes: DataFrame) -> DataFrame:
    """A scalar field's rows get component 0."""
    return modes if "c" in modes.columns else modes.withColumn("c", F.lit(0))


def components(modes: DataFrame) -> int:
    top = modes.agg(F.max("c")).first()[0]
    return 0 if top is None else top + 1


def widen(modes: DataFrame, grid: Grid, m: int, keys: list[str]) -> DataFrame:
    """A row for each mode and key."""
    sums = []
    for c in range(m):
        own = F.col("c") == c
        sums += [F.sum(F.when(own, F.col("re"))).alias(f"r{c}"), F.sum(F.when(own, F.col("im"))).alias(f"m{c}")]
    wide = modes.groupBy(*place(grid), *keys).agg(*sums)
    return wide.na.fill(0.0, [f"{x}{c}" for c in range(m) for x in "rm"])


def narrow(wide: DataFrame, grid: Grid, m: int, keys: list[str]) -> DataFrame:
    parts = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"r{c}").alias("re"), F.col(f"m{c}").alias("im")) for c in range(m)))
    return wide.select(*place(grid), *keys, F.explode(parts).alias("p")).select(*place(grid), *keys, "p.c", "p.re", "p.im")


def hermitian(modes: DataFrame, grid: Grid, m: int, keys: list[str], columns: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Wide sums of half of each mode and half of its partner's conjugate, in one pass.

    ``columns``: for each name a complex expression of re, im and the indices; the result has
    {name}{c}r and {name}{c}m.
    """
    half = modes.select(*place(grid), *keys, "c", *(x.alias(f"{n}{s}") for n, z in columns.items() for s, x in zip("rm", z, strict=True)))
    own = F.struct(*(F.col(i).cast("int").alias(i) for i in IDS[: grid.nd]), F.lit(1).alias("sign"))
    partner = F.struct(*(negated(grid, d).alias(f"i{d}") for d in range(grid.nd)), F.lit(-1).alias("sign"))
    both = half.select("field_id", *keys, "c", *(f"{n}{s}" for n in columns for s in "rm"), F.explode(F.array(own, partner)).alias("at"))
    value = lambda n, s: F.col(f"{n}{s}") / 2 if s == "r" else F.col(f"{n}m") * F.col("sign") / 2
    sums = [F.sum(F.when(F.col("c") == c, value(n, s)).otherwise(0.0)).alias(f"{n}{c}{s}") for n in columns for c in range(m) for s in "rm"]
    return both.select("*", "at.*").drop("at").groupBy(*place(grid), *keys).agg(*sums)


_KEPT: list[DataFrame] = []


def once(modes: DataFrame) -> DataFrame:
    """Modes that several branches of a plan read: made once, kept in memory and beyond it on disk.

    A lost executor's part is made again.  ``release`` forgets what has been kept.
    """
    if modes.isStreaming or modes.storageLevel.useMemory or modes.storageLevel.useDisk:
        return modes
    _KEPT.append(modes.persist())
    return _KEPT[-1]


def release() -> None:
    while _KEPT:
        _KEPT.pop().unpersist()


def read_often(f: DataFrame, u: DataFrame | None, m: int | None, grid: Grid) -> tuple[DataFrame, DataFrame, int]:
    """Advected field and velocity, kept for their several uses, and the number of components."""
    from . import stack

    if stack.is_packed(f):
        return f, f if u is None else u, m or stack.components(f, grid)
    own = once(as_component_field(f))
    return own, own if u is None or u is f else u if stack.is_packed(u) else once(u), m or components(own)
