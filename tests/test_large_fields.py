"""Fields, series and spheres that are cut up, against whole ones and against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eddyscale.functions import spectral
from eddyscale.operators import coarse, pencil, scattered, sphere, tod, transfer
from eddyscale.operators import modes as M
from eddyscale.operators import transforms as T
from eddyscale.plans import dispatch
from eddyscale.plans import types as P


def arrays(grid, m, seed=0, fields=("a", "b")):
    rng = np.random.default_rng(seed)
    return {f: rng.normal(size=(m, *grid.ns)) + 1j * rng.normal(size=(m, *grid.ns)) for f in fields}


def modes(spark, grid, held):
    rows = [(f, *map(int, at[1:]), int(at[0]), float(z[at].real), float(z[at].imag)) for f, z in held.items() for at in np.ndindex(z.shape)]
    return spark.createDataFrame(rows, "field_id string, " + ", ".join(f"i{d} int" for d in range(grid.nd)) + ", c int, re double, im double")


def alike(got, want, keys, value, tolerance=1e-11):
    a, b = ({tuple(r[k] for k in keys): r[value] for r in df.collect()} for df in (got, want))
    size = max(map(abs, b.values()))
    assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in b) < tolerance * size


def exchanges(df) -> int:
    """Shuffles of a plan; one that is used again counts once."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange hashpartitioning" in line and "Reused" not in line for line in plan.splitlines())


# --- pencils ------------------------------------------------------------------------------------

CASES = [
    (P.Grid((10, 12)), 3, P.OrszagTwoThirds(), P.KineticEnergy()),
    (P.Grid((10, 12)), (2, 5), P.PaddedThreeHalves(), P.Enstrophy()),
    (P.Grid((7, 9)), 4, P.PaddedThreeHalves(), P.KineticEnergy()),
    (P.Grid((6, 9, 8), (1.0, 2.0, 3.0)), 2, P.OrszagTwoThirds(), P.Helicity()),
    (P.Grid((16,)), 3, P.NoDealiasing(), P.KineticEnergy()),
]


@pytest.mark.parametrize("case", CASES)
def test_flux_by_pencils(spark, case):
    grid, parts, rule, invariant = case
    f = modes(spark, grid, arrays(grid, grid.nd)).cache()
    options = {"dealiasing": rule, "invariant": invariant}
    got, want = pencil.spectral_flux(f, grid, parts=parts, **options), transfer.spectral_flux(f, grid, method="fft", **options)
    for value in ("transfer", "flux"):
        alike(got, want, ["field_id", "shell"], value)


def test_scalar_flux_by_pencils(spark):
    """A velocity and a scalar, each of which lacks blocks that the other has."""
    grid = P.Grid((9, 12))
    u, th = modes(spark, grid, arrays(grid, 2)).where("i0 < 6"), modes(spark, grid, arrays(grid, 1, 1)).where("i1 > 3")
    alike(pencil.scalar_flux(th, u, grid, parts=3, m=1), transfer.scalar_flux(th, u, grid, method="fft", m=1), ["field_id", "shell"], "flux")


def test_one_field_in_64_parts(spark):
    """A cube of 64 whose tasks hold a 64th, against one that holds it whole; a shuffle for each axis and direction."""
    grid = P.Grid((64, 64, 64))
    hashed = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(2001)) / 1000 - 1)
    rows = spark.range(3 * 64**3).select(F.lit("f").alias("field_id"), (F.col("id") % 3).cast("int").alias("c"), F.floor(F.col("id") / 3).alias("id"))
    rows = rows.select("field_id", "c", *[a.alias(f"i{d}") for d, a in enumerate((F.floor(F.col("id") / 64**e) % 64).cast("int") for e in (2, 1, 0))], hashed(1).alias("re"), hashed(2).alias("im"), F.col("id"))
    f = rows.select("field_id", "i0", "i1", "i2", "c", (F.col("re") * (F.col("c") + 1)).alias("re"), "im").cache()
    bins = P.LinearBinning(8.0)
    got = pencil.spectral_flux(f, grid, 3, parts=8, binning=bins)
    alike(got, transfer.spectral_flux(f, grid, method="fft", m=3, binning=bins), ["field_id", "shell"], "transfer", 1e-9)
    M.release()
    cut = pencil.cut_of(grid, None, 8)
    blocks = pencil.blocks(f, grid, 3, cut)
    term, _ = pencil.term_blocks(blocks, grid, 3, cut)
    assert exchanges(blocks) == 1 and exchanges(term) == 1 + 2 * 3 - 2  # the first axis' way back is the last step's


def test_transforms_by_pencils(spark):
    grid = P.Grid((6, 5, 4))
    held = {f: z.real for f, z in arrays(grid, 2).items()}
    points = modes(spark, grid, held).drop("im").withColumnRenamed("re", "value")
    cut = pencil.cut_of(grid, 2, (2, 3, 1))
    spectrum = pencil.transformed(pencil.blocks(points, grid, 2, cut, ("value",)), grid, cut)
    alike(pencil.unblock(spectrum, grid, cut), T.forward(points, grid, "fft"), ["field_id", "i0", "i1", "i2", "c"], "im")
    back = pencil.unblock(pencil.transformed(spectrum, grid, cut, forward=False), grid, cut, ("value",))
    alike(back, points, ["field_id", "i0", "i1", "i2", "c"], "value")


def test_a_cut_follows_the_size():
    assert pencil.cut_of(P.Grid((64, 64))).parts == (1, 1)
    big = pencil.cut_of(P.Grid((512,) * 3)).parts
    assert 12 * 512**3 / big[0] ** 2 <= pencil.PENCIL
    with pytest.raises(ValueError):
        pencil.cut_of(P.Grid((8, 8)), None, (2, 0))


# --- masked coarse graining ---------------------------------------------------------------------


@pytest.mark.parametrize("ns", [(8, 10), (6, 5, 4)])
def test_masked_coarse_graining(spark, ns):
    grid, nd = P.Grid(ns), len(ns)
    rng = np.random.default_rng(3)
    u = {f: rng.normal(size=(nd, *ns)) for f in "ab"}
    w = {f: rng.random(ns) < 0.7 for f in "ab"}
    rows = [(f, *map(int, at[1:]), int(at[0]), float(u[f][at]), bool(w[f][at[1:]])) for f in u for at in np.ndindex(u[f].shape)]
    df = spark.createDataFrame(rows, "field_id string, " + ", ".join(f"i{d} int" for d in range(nd)) + ", c int, value double, wet boolean").cache()
    places, ids = [f"i{d}" for d in range(nd)], ["field_id", *(f"i{d}" for d in range(nd))]
    kind, scale = P.GaussianFilter(), 1.5
    whole = coarse.flux_map(df.drop("wet"), grid, kind, scale, keep=True, any_dimension=True)
    cut = coarse.masked_flux_map(df.drop("wet"), grid, kind, scale, keep=True, parts=2)
    for name in ("flux", "tau01", "s10"):
        alike(cut, whole, ids, name)
    # with a mask: sums over wet cells, cell by cell
    got = {(r["field_id"], *(r[p] for p in places)): r for r in coarse.masked_flux_map(df, grid, kind, scale, parts=3).collect()}
    k, response = np.meshgrid(*spectral.axes(grid), indexing="ij"), spectral.filter_array(kind, spectral.magnitude_array(grid), scale)
    kernel, slopes = np.fft.ifftn(response).real, [np.fft.ifftn(1j * k[d] * response).real for d in range(nd)]
    every = list(np.ndindex(*ns))
    index = np.array([[np.ravel_multi_index([(a - b) % n for a, b, n in zip(p, q, ns, strict=True)], ns) for q in every] for p in every])
    for f in u:
        wet = w[f].ravel().astype(float)
        mean = lambda x, g, wet=wet: g.ravel()[index] @ (wet * x.ravel())
        one = np.ones(ns)
        mass, bar = mean(one, kernel), []
        bar = [mean(u[f][i], kernel) / mass for i in range(nd)]
        slope = [[(mean(u[f][i], slopes[j]) - bar[i] * mean(one, slopes[j])) / mass for j in range(nd)] for i in range(nd)]
        want = -sum((mean(u[f][i] * u[f][j], kernel) / mass - bar[i] * bar[j]) * (slope[i][j] + slope[j][i]) / 2 for i in range(nd) for j in range(nd))
        for n, p in enumerate(every):
            assert got[f, *p]["wet"] == bool(wet[n]) and abs(got[f, *p]["flux"] - (want[n] if wet[n] else 0)) < 1e-11
    means = {r["field_id"]: r["mean_flux"] for r in coarse.mean_flux(coarse.masked_flux_map(df, grid, kind, scale), wet="wet").collect()}
    assert all(abs(means[f] - np.mean([got[f, *p]["flux"] for p in every if w[f][p]])) < 1e-12 for f in u)


def test_parts_of_any_field_name(spark):
    """A field's name may hold anything, the dispatcher's too."""
    grid = P.Grid((6, 6))
    held = {"a\x01b": np.random.default_rng(0).normal(size=(2, 6, 6)), '{"x"': np.random.default_rng(1).normal(size=(2, 6, 6))}
    points = modes(spark, grid, held).drop("im").withColumnRenamed("re", "value")
    got = coarse.flux_map(points, grid, P.GaussianFilter(), 1.0, P.HelmholtzDecomposition())
    assert {(r["field_id"], r["component"]) for r in got.collect()} == {(f, c) for f in held for c in ("rotational", "divergent")}
    assert dispatch.from_points(P.MaskedCoarseGraining(P.GaussianFilter(), 1.0, 2), points, grid).count() == 72


# --- scattered points ---------------------------------------------------------------------------


@pytest.mark.parametrize(("ns", "tolerance", "parts"), [((8, 6), 1e-6, 2), ((8, 6), 1e-12, (3, 1)), ((20,), 1e-9, 4), ((6, 4, 5), 1e-4, 2)])
def test_scattered_to_a_tolerance(spark, ns, tolerance, parts, monkeypatch):
    monkeypatch.setattr(scattered, "SHARE", 16)  # so that blocks have several shares
    grid, nd, n = P.Grid(ns), len(ns), 150
    rng = np.random.default_rng(0)
    at = {(f, i): [-np.pi] * nd if i == 3 else list(map(float, rng.uniform(-np.pi, np.pi, nd) * (0.2 if i % 3 else 1))) for f in "ab" for i in range(n)}
    rows = [(f, i, *x, c, float(rng.normal())) for (f, i), x in at.items() for c in (0, 7)]
    df = spark.createDataFrame(rows, "field_id string, point long, " + ", ".join(f"x{d} double" for d in range(nd)) + ", c int, value double").cache()
    places = [f"i{d}" for d in range(nd)]
    dense, fast = T.scattered_forward(df, grid), T.scattered_forward(df, grid, tolerance)
    rows_of = lambda d, keys: {tuple(r[k] for k in keys): r for r in d.collect()}
    a, b = (rows_of(d, ["field_id", "c", *places]) for d in (fast, dense))
    off = lambda x, y: np.linalg.norm(np.array(x) - np.array(y)) / np.linalg.norm(y)
    assert a.keys() == b.keys() and off([complex(a[k]["re"], a[k]["im"]) for k in b], [complex(b[k]["re"], b[k]["im"]) for k in b]) < tolerance
    points, spectrum = df.where("c = 0").drop("c", "value"), dense.cache()
    a, b = (rows_of(T.scattered_inverse(spectrum, points, grid, tolerance=t), ["field_id", "point", "c"]) for t in (tolerance, None))
    assert a.keys() == b.keys() and off([a[k]["value"] for k in b], [b[k]["value"] for k in b]) < tolerance


def test_tolerance_is_checked(spark):
    with pytest.raises(ValueError):
        scattered.Bump(0.0)


# --- series -------------------------------------------------------------------------------------


def test_tod_by_places_and_tiles(spark):
    """Values, budgets, coefficients and shapes don't depend on how places and triads are cut."""
    rng = np.random.default_rng(0)
    nt, nv, nx = 80, 2, 37
    x, w = rng.normal(size=(nt, nv, nx)), rng.random(nx) + 0.5
    df = spark.createDataFrame([(t, v, i, float(x[t, v, i])) for t in range(nt) for v in range(nv) for i in range(nx)], "t long, var int, x int, value double").cache()

    def run(**cut):
        got = tod.tod(df, window=16, weight=list(w), return_coefficients=True, return_auxiliary_modes=True, nfreq=5, **cut)
        values = {(r["l"], r["n"], r["mode"]): (r["lambda"], r["budget"]) for r in got.bispectrum.collect()}
        shapes = {}
        for r in got.modes.collect():
            shapes.setdefault((r["l"], r["n"], r["kind"], r["mode"]), np.zeros((nv, nx), complex))[r["state"], r["x"]] = complex(r["re"], r["im"])
        power = {}
        for r in got.coefficients.collect():
            power[r["l"], r["n"], r["kind"], r["mode"]] = power.get((r["l"], r["n"], r["kind"], r["mode"]), 0) + r["re"] ** 2 + r["im"] ** 2
        M.release()
        return values, shapes, power

    (a, shape_a, power_a), (b, shape_b, power_b) = run(places=nx, edge=100), run(places=2, edge=3)
    assert a.keys() == b.keys() and shape_a.keys() == shape_b.keys() and power_a.keys() == power_b.keys()
    top = max(v for v, _ in a.values())
    assert max(max(abs(p - q) for p, q in zip(a[k], b[k], strict=True)) for k in a) < 1e-12 * top
    assert max(abs(power_a[k] - power_b[k]) for k in power_a) < 1e-10 * max(power_a.values())
    p = tod.parameters(nt, 16)
    scale = 1 / p.window.mean() / 16
    q = np.stack([np.fft.fft(x[s : s + 16] * p.window[:, None, None], axis=0) * scale for s in tod.block_starts(nt, p)], -1)
    for l, n in {k[:2] for k in a}:  # noqa: E741
        held = [b[l, n, i][0] for i in range(p.blocks) if (l, n, i) in b]
        u, v = (np.stack([shape_b[l, n, kind, i].ravel() for i in range(len(held))], 1) for kind in ("convective", "recipient"))
        cross = (q[(n - l) % 16] * q[l % 16]).reshape(-1, p.blocks) @ q[n % 16].reshape(-1, p.blocks).conj().T / p.blocks
        assert np.abs((u * held) @ v.conj().T - cross).max() < 1e-11 * top


def test_frequencies_go_to_tiles_not_to_triads():
    found = tod.triads(64)
    copies = {edge: sum(map(len, tod.users(tod.tiles(found, edge)).values())) for edge in (1, 8, 16)}
    assert copies[1] > 2.5 * len(found) * 0.9  # a triad has three frequencies
    assert copies[8] < copies[1] / 5 and copies[16] < copies[1] / 9
    assert sorted(t for own in tod.tiles(found, 8).values() for t in own) == sorted(found)


def test_many_places_in_small_blocks(spark):
    """Places by the ten thousand; what a task gives back are factors of a fixed size."""
    n = 20_000
    rows = spark.range(n).select(F.explode(F.sequence(F.lit(0), F.lit(31))).alias("t"), F.lit(0).alias("var"), F.col("id").cast("int").alias("x"))
    rows = rows.withColumn("value", F.sin(F.col("x") * 0.37 + F.col("t")) + F.cos(F.col("x") * F.col("t") * 0.11))
    got, whole = (tod.tod(rows, window=8, outputs=("bispectrum",), places=p).bispectrum for p in (500, n))
    alike(got, whole, ["l", "n", "mode"], "lambda", 1e-12)


def test_a_product_that_looks_at_neighbours_has_all_places(spark):
    rng = np.random.default_rng(1)
    df = spark.createDataFrame([(t, 0, i, float(rng.normal())) for t in range(40) for i in range(9)], "t long, var int, x int, value double")
    slope = lambda k, a: k * np.gradient(a, axis=1)
    seen = tod.tod(df, window=8, q=slope, outputs=("bispectrum",), nfreq=2).bispectrum
    alike(seen, tod.tod(df, window=8, q=slope, outputs=("bispectrum",), nfreq=2, places=9, local=True).bispectrum, ["l", "n", "mode"], "lambda")


# --- spheres ------------------------------------------------------------------------------------


@pytest.mark.parametrize(("kind", "nrings", "lmax"), [("gauss", 9, 8), ("equiangular", 9, 8), ("equiangular", 10, 6), ("equiangular", 1, 0)])
def test_rings_give_back_coefficients(spark, kind, nrings, lmax):
    rng, nphi = np.random.default_rng(1), max(2 * nrings, 2 * lmax + 1)
    theta, phi = np.meshgrid(sphere.rings(kind, nrings)[0], np.arange(nphi) * 2 * np.pi / nphi, indexing="ij")
    a = rng.normal(size=(2, (lmax + 1) ** 2)) + 1j * rng.normal(size=(2, (lmax + 1) ** 2))
    for deg in range(lmax + 1):
        a[:, deg * deg + deg] = a[:, deg * deg + deg].real
        for m in range(1, deg + 1):
            a[:, deg * deg + deg - m] = (-1) ** m * a[:, deg * deg + deg + m].conj()
    value = (a @ sphere.harmonics(lmax, theta.ravel(), phi.ravel())).real.reshape(2, nrings, nphi)
    df = spark.createDataFrame([("f", i, j, c, float(value[c, i, j])) for c in range(2) for i in range(nrings) for j in range(nphi)], "field_id string, i0 int, i1 int, c int, value double")
    got = {(r["c"], r["l"], r["m"]): complex(r["re"], r["im"]) for r in sphere.ring_analysis(df, nrings, nphi, lmax, 2, kind, parts=3).collect()}
    assert len(got) == 2 * (lmax + 1) ** 2 and max(abs(z - a[c, deg * deg + deg + m]) for (c, deg, m), z in got.items()) < 1e-12
    if lmax:
        with pytest.raises(ValueError):
            sphere.ring_analysis(df, nrings, 2 * lmax, lmax, 2, kind)


@pytest.mark.parametrize("lmax", [0, 1, 6])
def test_points_of_a_sphere_to_a_tolerance(spark, lmax):
    rng = np.random.default_rng(4)
    rows = [("f", float(np.arccos(rng.uniform(-1, 1))) if i % 9 else 0.0, float(rng.uniform(0, 2 * np.pi)), c, float(rng.normal()), float(rng.random())) for i in range(120) for c in (0, 2)]
    df = spark.createDataFrame(rows, "field_id string, theta double, phi double, c int, value double, weight double").cache()
    for part in ("re", "im"):
        fast, dense = (sphere.spherical_analysis(df, lmax, tolerance=t) for t in (1e-10, None))
        a, b = ({(r["l"], r["m"], r["c"]): r[part] for r in x.collect()} for x in (fast, dense))
        assert a.keys() == b.keys() and max(abs(a[k] - b[k]) for k in b) < 1e-8


def test_high_degrees_are_orthonormal():
    theta, weight = sphere.rings("gauss", 513)
    for m in (0, 1, 100, 400, 512):
        held = np.array([p for _, p in sphere.legendre(512, m, theta)])
        some = held[[0, len(held) // 2, -1]]
        assert np.abs((some * weight) @ held.T * 2 * np.pi - np.eye(len(held))[[0, len(held) // 2, -1]]).max() < 1e-10


def test_coefficients_go_to_the_diagnostics(spark):
    """Wavenumbers that are given reach both routes and pencils alike."""
    grid = sphere.coefficient_grid(3)
    assert grid.ns == (4, 7) and [a.tolist() for a in spectral.axes(grid)] == [list(range(4)), list(range(7))]
    assert [a.tolist() for a in spectral.axes(sphere.coefficient_grid(3, by_order=True))] == [list(range(4)), [0, 1, 2, 3, -3, -2, -1]]
    rng = np.random.default_rng(0)
    rows = [("f", deg, m, c, float(rng.normal()), float(rng.normal())) for deg in range(4) for m in range(-deg, deg + 1) for c in (0, 1)]
    f = sphere.as_modes(spark.createDataFrame(rows, "field_id string, l int, m int, c int, re double, im double"), 3).cache()
    options = {"dealiasing": P.NoDealiasing(), "binning": P.LinearBinning(1.0)}
    joins = transfer.spectral_flux(f, grid, m=2, **options)
    alike(transfer.spectral_flux(f, grid, m=2, method="fft", **options), joins, ["shell"], "flux")
    alike(pencil.spectral_flux(f, grid, 2, parts=2, **options), joins, ["shell"], "flux")
    with pytest.raises(ValueError):
        P.Grid((3, 3), waves=((1.0,), None))
