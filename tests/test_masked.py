"""Parts of a velocity with dry cells, against a dense solve and against what they must fulfil."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyscale.operators import decompose, masked
from eddyscale.plans import types as P


def points(spark, held):
    """Long rows of {field: (velocity, wet)}."""
    rows = [(f, *map(int, at[1:]), int(at[0]), float(u[at]), bool(wet[at[1:]])) for f, (u, wet) in held.items() for at in np.ndindex(u.shape)]
    nd = next(iter(held.values()))[0].ndim - 1
    return spark.createDataFrame(rows, "field_id string, " + ", ".join(f"i{d} int" for d in range(nd)) + ", c int, value double, wet boolean")


def faces(u, wet, centred):
    """Open faces and what goes through them."""
    nd = len(u)
    open_ = np.stack([wet & np.roll(wet, -1, d) for d in range(nd)])
    through = np.stack([(u[d] + np.roll(u[d], -1, d)) / 2 if centred else u[d] for d in range(nd)])
    return open_, np.where(open_, through, 0.0)


def dense(u, wet, h, centred):
    """The gradient nearest to the flow, by least squares over all open faces."""
    open_, through = faces(u, wet, centred)
    index = np.arange(wet.size).reshape(wet.shape)
    rows, right = [], []
    for d, *at in np.argwhere(open_):
        nxt = list(at)
        nxt[d] = (nxt[d] + 1) % wet.shape[d]
        row = np.zeros(wet.size)
        row[index[tuple(nxt)]] += 1 / h[d]
        row[index[tuple(at)]] -= 1 / h[d]
        rows.append(row)
        right.append(through[(d, *at)])
    out = np.zeros(u.shape)
    if rows:
        a = np.array(rows)
        out[tuple(np.argwhere(open_).T)] = a @ np.linalg.lstsq(a, np.array(right), rcond=None)[0]
    return out, through - out


def parts_of(df, shapes):
    got = {f: {n: np.zeros(shape) for n in ("divergent", "rotational")} for f, shape in shapes.items()}
    nd = len(next(iter(shapes.values()))) - 1
    for r in df.collect():
        got[r["field_id"]][r["component"]][(r["c"], *(r[f"i{d}"] for d in range(nd)))] += r["value"]
    return got


CASES = [((7, 9), None, True, 0.3), ((8, 8), None, False, 0.4), ((4, 5, 6), None, True, 0.2), ((5, 6), (2, 3), True, 0.3), ((3, 4, 2), 2, False, 0.2), ((13,), 4, False, 0.1)]


@pytest.mark.parametrize("case", CASES)
def test_parts_with_dry_cells(spark, case):
    ns, parts, centred, dry = case
    rng = np.random.default_rng(1)
    nd, h = len(ns), tuple(0.5 + 0.25 * d for d in range(len(ns)))
    held = {f: (rng.normal(size=(nd, *ns)), rng.random(ns) > dry) for f in ("a", "b")}
    held["none wet"] = (rng.normal(size=(nd, *ns)), np.zeros(ns, bool))
    held["all wet"] = (rng.normal(size=(nd, *ns)), np.ones(ns, bool))
    df = masked.helmholtz(points(spark, held), P.Grid(ns), h, centred, parts=parts)
    got = parts_of(df, {f: u.shape for f, (u, _) in held.items()})
    for f, (u, wet) in held.items():
        open_, through = faces(u, wet, centred)
        div, rot = got[f]["divergent"], got[f]["rotational"]
        want = dense(u, wet, h, centred)
        assert np.abs(div - want[0]).max() < 1e-9 and np.abs(rot - want[1]).max() < 1e-9
        assert np.abs(div + rot - through).max() < 1e-12 and not div[~open_].any() and not rot[~open_].any()
        out = sum((rot[d] - np.roll(rot[d], 1, d)) / h[d] for d in range(nd))
        assert np.abs(out).max() < 1e-8
        for a in range(nd):
            for b in range(a):
                ring = open_[a] & open_[b] & np.roll(open_[a], -1, b) & np.roll(open_[b], -1, a)
                around = h[b] * div[b] + h[a] * np.roll(div[a], -1, b) - h[b] * np.roll(div[b], -1, a) - h[a] * div[a]
                assert np.abs(around[ring]).max(initial=0) < 1e-8


def test_odd_cells_are_dry(spark):
    """Missing cells and blocks, flags and components that are null or not finite; a null field; no rows at all."""
    rng = np.random.default_rng(2)
    u, wet = rng.normal(size=(2, 6, 8)), np.ones((6, 8), bool)
    for at in ((0, 0), (1, 5), (3, 3), (4, 7)):
        wet[at] = False
    wet[:, 4:6] = False  # a block without rows
    full = points(spark, {"a": (u, wet)}).where("i1 not between 4 and 5")
    odd = full.withColumn("wet", F.when(~F.col("wet") & (F.col("i0") == 0), None).otherwise(F.col("wet") | F.col("i0").isin(1, 3)))
    value = F.when((F.col("i0") == 1) & (F.col("i1") == 5), None).when((F.col("i0") == 3) & (F.col("i1") == 3) & (F.col("c") == 1), float("inf"))
    odd = odd.withColumn("value", F.when(value.isNotNull() | ((F.col("i0") == 1) & (F.col("i1") == 5)), value).otherwise(F.col("value")))
    key = F.when(F.lit(True), F.lit(None).cast("string"))
    got = masked.helmholtz(odd.unionByName(odd.withColumn("field_id", key)), P.Grid((6, 8)), parts=4)
    want = dense(u, wet, (2 * np.pi / 6, 2 * np.pi / 8), True)
    for own in (got.where("field_id = 'a'"), got.where("field_id is null").fillna("a", ["field_id"])):
        one = parts_of(own, {"a": u.shape})["a"]
        assert np.abs(one["divergent"] - want[0]).max() < 1e-9 and np.abs(one["rotational"] - want[1]).max() < 1e-9
    assert masked.helmholtz(full.where("false"), P.Grid((6, 8)), parts=2).count() == 0


def test_steps_do_not_grow_with_the_grid(spark):
    """An island in a sea of any size: sixteen times the cells take no more than twice the steps."""
    least = []
    for n in (16, 64):
        x = np.arange(n)
        island = (np.abs(x[:, None] - n / 2) < n / 5) & (np.abs(x[None] - n / 2) < n / 5)
        df = points(spark, {"a": (np.random.default_rng(3).normal(size=(2, n, n)), ~island)})
        least.append(next(k for k in range(4, 80, 4) if _solves(df, P.Grid((n, n)), k)))
    assert least[1] <= 2 * least[0]


def _solves(df, grid, most):
    try:
        return masked.helmholtz(df, grid, most=most, tolerance=1e-8).count() > 0
    except Exception as error:
        assert "no solution within" in str(error)
        return False


def test_too_few_steps_are_an_error(spark):
    u = np.random.default_rng(4).normal(size=(2, 6, 6))
    with pytest.raises(ArithmeticError):
        masked.helmholtz(points(spark, {"a": (u, np.ones((6, 6), bool) & (np.arange(6) % 3 > 0))}), P.Grid((6, 6)), most=1, parts=2)


def test_points_with_dry_cells_are_parted_there(spark):
    rng = np.random.default_rng(5)
    u, wet = rng.normal(size=(2, 5, 6)), rng.random((5, 6)) > 0.2
    df = points(spark, {"a": (u, wet)})
    got = parts_of(decompose.decompose_points(df, P.Grid((5, 6)), P.DivergentDecomposition()), {"a": u.shape})["a"]
    assert np.abs(got["divergent"] - dense(u, wet, (2 * np.pi / 5, 2 * np.pi / 6), True)[0]).max() < 1e-9 and not got["rotational"].any()
    with pytest.raises(ValueError):
        decompose.decompose_points(df, P.Grid((5, 6)), P.HelicalDecomposition())
