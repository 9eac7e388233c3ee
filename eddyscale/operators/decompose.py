"""Named parts of a vector field, mode by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import spectral
from ..plans.types import DivergentDecomposition, Grid, HelicalDecomposition, HelmholtzDecomposition, NoDecomposition, RotationalDecomposition, ToroidalPoloidalDecomposition
from . import modes as M


# A part is made in stages: each maps a frame to one with more columns, the last names the
# parts' components.  Stages keep expressions short, which a single one of a part wouldn't be.


def _dot(a: list[Column], b: list[Column]) -> Column:
    return spectral.add([x * y for x, y in zip(a, b, strict=True)])


def _columns(name: str, n: int) -> list[Column]:
    return [F.col(f"{name}{j}") for j in range(n)]


def _cross(a, b):
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def _with(df: DataFrame, **vectors) -> DataFrame:
    """Columns name0, name1.. of each vector, or name of a single column."""
    made = {}
    for name, v in vectors.items():
        made |= {f"{name}{j}": x for j, x in enumerate(v)} if isinstance(v, list) else {name: v}
    return df.withColumns(made)


def _helmholtz(df: DataFrame, n: int):
    k, r, m = _columns("k_", n), _columns("r", n), _columns("m", n)
    df = _with(df, k2=_dot(k, k))
    df = _with(df, ar=F.when(F.col("k2") > 0, _dot(k, r) / F.col("k2")).otherwise(0.0), am=F.when(F.col("k2") > 0, _dot(k, m) / F.col("k2")).otherwise(0.0))
    div = [(k[j] * F.col("ar"), k[j] * F.col("am")) for j in range(n)]
    # the mean flow has no direction of its own and counts as rotational
    rot = [(r[j] - div[j][0], m[j] - div[j][1]) for j in range(n)]
    return df, {"rotational": rot, "divergent": div}


def _unit(df: DataFrame) -> DataFrame:
    k = _columns("k_", 3)
    df = _with(df, size=F.sqrt(_dot(k, k)))
    return _with(df, e=[F.when(F.col("size") > 0, x / F.col("size")).otherwise(0.0) for x in k])


def _helical(df: DataFrame, n: int):
    e, r, m = _columns("e", 3), _columns("r", 3), _columns("m", 3)
    df = _unit(df)
    df = _with(df, er=_dot(e, r), em=_dot(e, m), tr=_cross(e, r), tm=_cross(e, m))
    tr, tm, there = _columns("tr", 3), _columns("tm", 3), F.col("size") > 0
    # half of the transverse part and of i k x u, to either side; the mean flow has no helicity
    part = lambda sign: [(F.when(there, (r[j] - e[j] * F.col("er") - sign * tm[j]) / 2).otherwise(0.0), F.when(there, (m[j] - e[j] * F.col("em") + sign * tr[j]) / 2).otherwise(0.0)) for j in range(3)]
    return df, {"positive": part(1), "negative": part(-1)}


def _toroidal(df: DataFrame, n: int):
    k, e, r, m = (_columns(x, 3) for x in ("k_", "e", "r", "m"))
    df = _with(_unit(df), flat=F.sqrt(k[0] * k[0] + k[1] * k[1]))
    tilted = F.col("flat") > 0
    df = _with(df, one=[F.when(tilted, k[1] / F.col("flat")).otherwise(1.0), F.when(tilted, -k[0] / F.col("flat")).otherwise(0.0), F.lit(0.0)])
    two = _cross(e, _columns("one", 3))
    df = _with(df, two=[F.when(tilted, x).otherwise(y) for x, y in zip(two, (0.0, 1.0, 0.0), strict=True)])
    df = _with(df, **{f"{a}{s}": F.when(F.col("size") > 0, _dot(_columns(a, 3), v)).otherwise(0.0) for a in ("one", "two") for s, v in (("r", r), ("m", m))})
    return df, {name: [(F.col(f"{a}r") * x, F.col(f"{a}m") * x) for x in _columns(a, 3)] for name, a in (("toroidal", "one"), ("poloidal", "two"))}


def _parts(kind, grid: Grid, m: int):
    if isinstance(kind, (HelmholtzDecomposition, RotationalDecomposition, DivergentDecomposition)):
        if grid.nd != 2 or m != 2:
            raise ValueError("Helmholtz parts are of two components in two dimensions")
        return _helmholtz
    if isinstance(kind, (HelicalDecomposition, ToroidalPoloidalDecomposition)):
        if grid.nd != 3 or m < 3:
            raise ValueError(f"{type(kind).__name__} needs three dimensions and components")
        return _helical if isinstance(kind, HelicalDecomposition) else _toroidal
    if callable(getattr(kind, "split", None)):
        return kind.split
    raise TypeError(f"decomposition: {kind!r}")


def decompose(modes: DataFrame, grid: Grid, kind, m: int | None = None, key: str = "component") -> DataFrame:
    """Modes with ``key``, the part's name; without a decomposition, the modes as they are."""
    if isinstance(kind, NoDecomposition):
        return modes
    m = m or M.components(modes)
    split = _parts(kind, grid, m)
    wide = _with(M.widen(modes, grid, m, []), k_=spectral.wavenumbers(grid))
    wide, made = split(wide, m)
    rows = F.array(*(F.struct(F.lit(name).alias(key), F.lit(c).alias("c"), re.alias("re"), im.alias("im")) for name in kind.parts for c, (re, im) in enumerate(made[name])))
    return wide.select(*M.place(grid), F.explode(rows).alias("p")).select(*M.place(grid), f"p.{key}", "p.c", "p.re", "p.im")


def decompose_points(points: DataFrame, grid: Grid, kind, method: str = "auto") -> DataFrame:
    """field_id, component, i0.., c, value: the parts of a field on the grid's points.

    Points with a column ``wet`` are parted on their wet cells (``masked``), which only divergence
    and rotation allow; values then belong to faces.
    """
    from . import masked
    from . import transforms as T

    if "wet" in points.columns:
        if not isinstance(kind, (HelmholtzDecomposition, RotationalDecomposition, DivergentDecomposition)):
            raise ValueError("with dry cells there are divergent and rotational parts only")
        return masked.helmholtz(points, grid).where(F.col("component").isin(*kind.parts))
    parts = decompose(T.forward(points, grid, method), grid, kind, grid.nd)
    # a part of a field is a field of its own meanwhile
    named = parts.withColumn("field_id", F.to_json(F.struct("field_id", "component"))).drop("component")
    back = T.inverse(named, grid, method, m=grid.nd)
    of = F.from_json("field_id", "field_id string, component string")
    return back.withColumn("of", of).select(F.col("of.field_id").alias("field_id"), F.col("of.component").alias("component"), *M.place(grid)[1:], "c", "value")
