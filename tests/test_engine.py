"""Properties of the transfer engine on seeded random fields, and parity of its two routes."""

import math

import numpy as np
import pytest

from eddyscale.functions import spectral
from eddyscale.operators import batch, coarse, decompose, density, nonlinear, shells, sphere, stack, tod, transfer
from eddyscale.operators import modes as M
from eddyscale.operators import transforms as T
from eddyscale.plans import dispatch
from eddyscale.plans import types as P
from eddyscale.sources import fields
from eddyscale.streaming import snapshots

MODES = "field_id string, i0 int, i1 int, i2 int, c int, re double, im double"


def modes(spark, arrays, grid):
    rows = []
    for name, a in arrays.items():
        for at in np.ndindex(a.shape):
            z = a[at]
            if z:
                rows.append((name, *(list(at[:-1]) + [0] * (3 - grid.nd)), at[-1], float(z.real), float(z.imag)))
    return spark.createDataFrame(rows, MODES).cache()


def solenoidal(grid, seed):
    rng = np.random.default_rng(seed)
    k = np.meshgrid(*spectral.axes(grid), indexing="ij")
    if grid.nd == 2:
        psi = np.fft.fftn(rng.normal(size=grid.ns)) / grid.size
        return np.stack([1j * k[1] * psi, -1j * k[0] * psi], -1)
    a = [np.fft.fftn(rng.normal(size=grid.ns)) / grid.size for _ in range(3)]
    return np.stack([1j * (k[1] * a[2] - k[2] * a[1]), 1j * (k[2] * a[0] - k[0] * a[2]), 1j * (k[0] * a[1] - k[1] * a[0])], -1)


G2, G3 = P.Grid((12, 12)), P.Grid((9, 9, 9))


@pytest.fixture(scope="module")
def flat(spark):
    return modes(spark, {"f": solenoidal(G2, 1), "g": solenoidal(G2, 2)}, G2)


@pytest.fixture(scope="module")
def cube(spark):
    return modes(spark, {"f": solenoidal(G3, 3)}, G3)


@pytest.fixture(scope="module")
def scalar(spark):
    rng = np.random.default_rng(4)
    return modes(spark, {n: np.fft.fftn(rng.normal(size=G2.ns))[..., None] / G2.size for n in "fg"}, G2)


def values(df, *keys, value="transfer"):
    return {tuple(r[k] for k in keys): r[value] for r in df.collect()}


def close(a, b, tol=1e-9):
    assert a.keys() == b.keys() and a
    size = max(map(abs, a.values())) or 1
    assert all(abs(a[k] - b[k]) <= tol * size for k in a)


def test_grids_and_shells():
    assert spectral.axis(8).tolist() == [0, 1, 2, 3, 4, -3, -2, -1]
    assert spectral.two_thirds_array(P.Grid((8,))).sum() == 3 and spectral.two_thirds_array(P.Grid((16,))).sum() == 9
    assert shells.shell_edges(P.LinearBinning(1.0), 5) == [0, 1, 2, 3, 4, 5]
    assert shells.shell_edges(P.LogarithmicBinning(1.0, 2.0), 16)[:5] == [1, 2, 4, 8, 16]
    assert shells.shell_edges(P.DyadicBinning(1.0), 16) == shells.shell_edges(P.LogarithmicBinning(1.0, 2.0), 16)
    assert shells.shell_edges(P.CustomBinning((0, 1, 3, 6, 10)), 99) == [0, 1, 3, 6, 10]
    assert shells.shell_array(np.array([-1, 0, 4.99, 5, 9, 10]), [0, 5, 10]).tolist() == [0, 1, 1, 2, 2, 0]
    assert shells.default_binning(P.Grid((8, 8), (2 * math.pi, 4 * math.pi))) == P.LinearBinning(0.5)
    assert [x for x in spectral.filter_array(P.SharpSpectralFilter(), np.arange(5), 1)] == [1, 1, 1, 1, 0]
    w = spectral.band_arrays(P.SmoothBands((1, 2, 4)), np.array([0.0, 1.0, 3.0]))
    assert np.allclose(w.sum(0), [0, 1, 1])
    assert np.allclose(spectral.taper("tukey", 9, 0.0), 1) and spectral.taper("hann", 5)[0] == 0
    assert [P.PaddedThreeHalves().length(n) for n in (8, 9, 11)] == [12, 15, 17]


@pytest.mark.parametrize("call", [
    lambda: shells.shell_edges(P.LinearBinning(0.0), 5), lambda: shells.shell_edges(P.LinearBinning(1.0), 0), lambda: shells.shell_edges(P.LogarithmicBinning(1.0, 1.0), 5),
    lambda: shells.shell_edges(P.LogarithmicBinning(6.0, 2.0), 5), lambda: shells.shell_edges(P.CustomBinning((1, 0)), 5), lambda: shells.shell_centers(P.LinearBinning(1.0), [0.0]),
    lambda: spectral.magnitude_array(G2, P.parallel_shells()), lambda: spectral.taper("tukey", 8, 1.5), lambda: tod.parameters(64, 3), lambda: tod.parameters(64, 16, 16), lambda: tod.parameters(20, 16, 0),
    lambda: density.check(P.Helicity(), G2), lambda: density.check(P.Enstrophy(), P.Grid((8,))), lambda: P.engine("x"), lambda: P.Grid(()),
])
def test_guards(call):
    with pytest.raises(ValueError):
        call()


def test_guards_of_operators(spark, flat, cube):
    for call in (
        lambda: transfer.spectral_flux(flat, G2, invariant=P.Helicity()),
        lambda: nonlinear.nonlinear_term(flat, G2, dealiasing=P.PaddedThreeHalves()),
        lambda: transfer.mode_to_mode(cube, P.Grid((12, 12, 12))),
        lambda: transfer.partial_fluxes(flat, G2, P.RotationalDecomposition()),
        lambda: decompose.decompose(flat, G2, P.HelicalDecomposition()),
        lambda: decompose.decompose(cube, G3, P.HelmholtzDecomposition()),
        lambda: coarse.flux_map(cube, G3, P.GaussianFilter(), 1.0),
        lambda: batch.batch_map(flat, lambda p: p, MODES, "median"),
        lambda: tod.tod(spark.createDataFrame([(0, 0, 0, 1.0)], "t long, var int, x int, value double"), mean_type="other"),
        lambda: tod.tod(spark.createDataFrame([(i, 0, 0, 1.0) for i in range(64)], "t long, var int, x int, value double"), weight=[1.0, 2.0]),
        lambda: spectral.taper("triangle", 8),
        lambda: batch.spread(flat, 0),
    ):
        with pytest.raises(ValueError):
            call()


@pytest.mark.parametrize("rule", [P.OrszagTwoThirds(), P.NoDealiasing()])
def test_routes_agree_and_conserve(flat, rule):
    a = values(transfer.spectral_flux(flat, G2, binning=P.LinearBinning(1.0), dealiasing=rule), "field_id", "shell")
    b = values(transfer.spectral_flux(flat, G2, binning=P.LinearBinning(1.0), dealiasing=rule, method="fft"), "field_id", "shell")
    close(a, b)
    if isinstance(rule, P.OrszagTwoThirds):
        assert abs(sum(a.values())) < 1e-10 * sum(map(abs, a.values()))


def test_single_mode_transfers_nothing(spark):
    a = np.zeros((8, 1), complex)
    a[1] = a[7] = 0.5
    got = transfer.spectral_flux(modes(spark, {"f": a}, P.Grid((8,))), P.Grid((8,))).collect()
    assert len(got) == 4 and all(abs(r["transfer"]) < 1e-12 and abs(r["flux"]) < 1e-12 for r in got)


def test_flux_is_the_running_sum(flat):
    rows = [r for r in transfer.spectral_flux(flat, G2).orderBy("shell").collect() if r["field_id"] == "f"]
    assert np.allclose(np.cumsum([r["transfer"] for r in rows]), [r["flux"] for r in rows])


def test_padding_equals_truncation_of_narrow_fields(spark):
    g = P.Grid((15, 15))
    a = solenoidal(g, 5) * (spectral.magnitude_array(g) < 3.5)[..., None]
    f = modes(spark, {"f": a}, g)
    close(values(transfer.spectral_flux(f, g, dealiasing=P.PaddedThreeHalves(), method="fft"), "shell"), values(transfer.spectral_flux(f, g, dealiasing=P.OrszagTwoThirds(), method="fft"), "shell"))


def test_grains_reduce_to_each_other(flat, scalar):
    for f, u, inv in ((flat, None, P.KineticEnergy()), (scalar, flat, P.PassiveScalar())):
        flux = values(transfer.spectral_flux(f, G2, u=u, invariant=inv), "field_id", "shell")
        s2s = transfer.shell_to_shell(f, G2, u=u, invariant=inv)
        matrix = values(s2s.matrix, "field_id", "n", "m")
        close(values(s2s.net, "field_id", "n", value="net"), flux)
        size = max(map(abs, matrix.values()))
        assert all(r["max_antisymmetry_error"] < 1e-11 * size for r in s2s.error.collect())
        close(matrix, values(transfer.shell_to_shell(f, G2, u=u, invariant=inv, method="fft").matrix, "field_id", "n", "m"))
        m2m = transfer.mode_to_mode(f, G2, u=u, invariant=inv)
        pairs = values(m2m.pairs, "field_id", "k0", "k1", "p0", "p1", value="s")
        assert abs(sum(pairs.values())) < 1e-9 * sum(map(abs, pairs.values()))
        shell = shells.shell_array(spectral.magnitude_array(G2), shells.edges_of(G2)[1])
        summed = dict.fromkeys(matrix, 0.0)
        for (name, a, b, c, d), v in pairs.items():
            summed[name, int(shell[a, b]), int(shell[c, d])] += v
        close(summed, matrix)


def test_bands(flat):
    bands = P.SmoothBands((1.0, 2.0, 3.0, 4.0), 0.5)
    got = transfer.band_to_band(flat, G2, bands)
    matrix = values(got.matrix, "field_id", "n", "m")
    size = max(map(abs, matrix.values()))
    assert abs(sum(matrix.values())) < 1e-10 * size and all(r["max_antisymmetry_error"] < 1e-10 * size for r in got.error.collect())
    close(matrix, values(transfer.band_to_band(flat, G2, bands, method="fft").matrix, "field_id", "n", "m"))


@pytest.mark.parametrize("kind", [P.HelicalDecomposition(), P.ToroidalPoloidalDecomposition()])
def test_parts_add_up(cube, kind):
    whole = {(r["i0"], r["i1"], r["i2"], r["c"]): complex(r["re"], r["im"]) for r in cube.collect()}
    total = dict.fromkeys(whole, 0j)
    for r in decompose.decompose(cube, G3, kind).collect():
        key = (r["i0"], r["i1"], r["i2"], r["c"])
        total[key] = total.get(key, 0) + complex(r["re"], r["im"])
        assert kind.parts[0] != "toroidal" or r["component"] != "toroidal" or r["c"] != 2 or abs(complex(r["re"], r["im"])) < 1e-12
    assert all(abs(total[k] - v) < 1e-10 for k, v in whole.items())


def test_partial_fluxes_total(cube, flat):
    for f, g, kind in ((cube, G3, P.HelicalDecomposition()), (flat, G2, P.HelmholtzDecomposition())):
        partial = transfer.partial_fluxes(f, g, kind)
        close(values(transfer.total_flux(partial), "field_id", "shell"), values(transfer.spectral_flux(f, g), "field_id", "shell"), 1e-8)
    only = values(partial, "s_k", "s_p", "s_q", "field_id", "shell")
    assert all(abs(v) < 1e-9 for k, v in only.items() if set(k[:3]) != {"rotational"})


def test_3d_invariants(cube):
    for inv in (P.Helicity(), P.KineticEnergy()):
        a = values(transfer.spectral_flux(cube, G3, invariant=inv), "shell")
        close(a, values(transfer.spectral_flux(cube, G3, invariant=inv, method="fft"), "shell"))
        assert abs(sum(a.values())) < 1e-9 * sum(map(abs, a.values()))


def test_geometry_conserves(cube):
    for geometry in (P.perpendicular_shells(), P.parallel_shells()):
        a = values(transfer.spectral_flux(cube, G3, geometry=geometry, binning=P.LinearBinning(1.0)), "shell")
        assert abs(sum(a.values())) < 1e-9 * sum(map(abs, a.values()))


def test_transforms_invert(spark):
    rng = np.random.default_rng(6)
    rows = [("f", i, j, 0, float(rng.normal())) for i in range(8) for j in range(6)]
    g = P.Grid((8, 6))
    points = spark.createDataFrame(rows, "field_id string, i0 int, i1 int, c int, value double")
    want = {(r[1], r[2]): r[4] for r in rows}
    for method in ("sql", "fft"):
        close(values(T.inverse(T.forward(points, g, method), g, method), "i0", "i1", value="value"), want)
    a = {(r["i0"], r["i1"]): complex(r["re"], r["im"]) for r in T.forward(points, g).collect()}
    b = {(r["i0"], r["i1"]): complex(r["re"], r["im"]) for r in T.forward(points, g, "fft").collect()}
    assert all(abs(a[k] - b[k]) < 1e-12 for k in a)


def test_coarse_graining_mean_is_the_spectral_flux(spark):
    g = P.Grid((12, 12))
    u = solenoidal(g, 7) * (spectral.magnitude_array(g) < 3.5)[..., None]
    f = modes(spark, {"f": u}, g)
    points = T.inverse(f, g, "fft")
    fluxes = coarse.flux_map(points, g, P.SharpSpectralFilter(), math.pi / 2.5, keep=True)
    assert {"tau01", "s11"} <= set(fluxes.columns)
    mean = coarse.mean_flux(fluxes).first()["mean_flux"]
    # transfers are cubic in the amplitude, and the reference's scale takes raw coefficients
    own = [r for r in transfer.spectral_flux(f, g, binning=P.CustomBinning((0.0, 2.5, 9.0)), dealiasing=P.NoDealiasing(), method="fft").collect() if r["shell"] == 1][0]["flux"]
    assert abs(mean - own * g.size**2) < 1e-9 * abs(mean)
    parts = coarse.flux_map(points, g, P.GaussianFilter(), 1.0, P.HelmholtzDecomposition())
    assert {r["component"] for r in parts.select("component").distinct().collect()} == {"rotational", "divergent"}


def test_scattered_equals_gridded(spark):
    g = P.Grid((7, 7))
    u = solenoidal(g, 8) * (spectral.magnitude_array(g) < 2.5)[..., None]
    points = T.inverse(modes(spark, {"f": u}, g), g, "fft").where("c < 2").toPandas()
    step = 2 * math.pi / 7
    # on [-pi, pi): grid index i stands at -pi + i * step; the far edge closes the range
    rows = [("f", int(r.i0 * 7 + r.i1), -math.pi + r.i0 * step, -math.pi + r.i1 * step, int(r.c), float(r.value)) for r in points.itertuples()]
    df = spark.createDataFrame(rows, "field_id string, point long, x0 double, x1 double, c int, value double")
    spectrum = T.scattered_forward(df, g)
    back = values(T.scattered_inverse(spectrum, df.where("c = 0").select("field_id", "point", "x0", "x1"), g), "point", "c", value="value")
    close(back, {(r[1], r[4]): r[5] for r in rows}, 1e-8)
    assert coarse.scattered_flux(df, g, P.GaussianFilter(), 1.0, keep=True).count() == 49


def test_spherical(spark):
    theta, phi, weight = sphere.gauss_grid(4)
    y = sphere.harmonics(4, theta, phi)
    assert np.allclose((y * weight) @ y.conj().T, np.eye(25), atol=1e-12)
    value = (1.5 * y[2 * 2 + 2 + 1] - 0.5 * y[3 * 3 + 3 - 2]).real
    df = spark.createDataFrame([("f", float(a), float(b), 0, float(v), float(w)) for a, b, v, w in zip(theta, phi, value, weight, strict=True)], "field_id string, theta double, phi double, c int, value double, weight double")
    got = {(r["l"], r["m"]): complex(r["re"], r["im"]) for r in sphere.spherical_analysis(df, 4).collect()}
    assert abs(got[2, 1] - 0.75) < 1e-12 and abs(got[3, -2] + 0.25) < 1e-12 and abs(got[1, 0]) < 1e-12
    assert sphere.spherical_analysis(df.drop("weight"), 2).count() == 9
    assert sphere.spherical_spectrum(sphere.spherical_analysis(df, 4)).count() == 5


def test_tod(spark):
    t = np.arange(256) * 0.1
    x = np.stack([np.sin(2 * np.pi * 2 * t) + 0.1 * np.cos(t), np.cos(2 * np.pi * 3 * t)], -1)
    df = spark.createDataFrame([(i, 0, j, float(x[i, j])) for i in range(256) for j in range(2)], "t long, var int, x int, value double")
    p = tod.parameters(256, 32)
    assert (p.noverlap, p.blocks, p.nfft) == (16, 15, 32) and tod.block_starts(50, tod.parameters(50, 16, 4))[-1] <= 34
    got = tod.tod(df, window=32, dt=0.1, nfreq=3, return_coefficients=True, return_auxiliary_modes=True)
    rows = got.bispectrum.collect()
    assert rows and all(r["lambda"] >= 0 for r in rows)
    assert {r["kind"] for r in got.modes.select("kind").distinct().collect()} == {"convective", "recipient", "donor", "catalyst"}
    # squared values add up to the norm of the cross product
    spectra = {}
    for r in tod.windowed_dft(df, 256, p).collect():
        spectra.setdefault(r["f"], np.zeros((2, p.blocks), complex))[r["x"], r["block"]] = complex(r["re"], r["im"])
    total = {}
    for r in rows:
        total[r["l"], r["n"]] = total.get((r["l"], r["n"]), 0) + r["lambda"] ** 2
    for (a, b), v in total.items():
        cross = (spectra[b - a] * spectra[a]) @ spectra[b].conj().T / p.blocks
        assert abs(v - np.linalg.norm(cross) ** 2) < 1e-10
    other = tod.tod(df, window=32, noverlap=8, mean_type="blockwise", weight=[1.0, 2.0], lhs=lambda a: np.concatenate([a, a]), q=lambda a, b: np.concatenate([a * b, a + b]), nfreq=1)
    assert other.bispectrum.count() and other.coefficients is None


def test_batch(spark, flat):
    import pandas as pd

    run = lambda p: pd.DataFrame({"field_id": p["field_id"].iloc[:1], "e": [float((p["re"] ** 2 + p["im"] ** 2).sum())]})
    schema = "field_id string, e double"
    each = [r["e"] for r in batch.batch_map(flat, run, schema).collect()]
    assert len(each) == 2
    assert abs(batch.batch_map(flat, run, schema, "sum").first()["e"] - sum(each)) < 1e-9
    assert abs(batch.batch_map(flat, run, schema, "mean").first()["e"] - sum(each) / 2) < 1e-9
    assert abs(batch.batch_map(flat, run, schema, lambda a, b: a.assign(e=a["e"] + b["e"]))["e"].iloc[0] - sum(each)) < 1e-9
    assert batch.spread(flat, 3).rdd.getNumPartitions() == 3


def test_dispatch_and_stream(spark, flat, tmp_path):
    with pytest.raises(TypeError):
        tod.parameters(64, "hann")
    got = dispatch.calculate_energy_transfer(P.SpectralFlux(P.LinearBinning(1.0)), flat, G2)
    assert got.columns == ["field_id", "shell", "k_shell", "transfer", "flux"]
    assert dispatch.calculate_energy_transfer(P.ShellToShell(), flat, G2, method="fft").net.count()
    assert dispatch.calculate_energy_transfer(P.ModeToMode(), flat, G2).net.count()
    assert dispatch.from_points(P.CoarseGraining(P.GaussianFilter(), 1.0), T.inverse(flat, G2, "fft"), G2).count() == 288
    with pytest.raises(TypeError):
        dispatch.calculate_energy_transfer("flux", flat, G2)
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for name in ("f", "g"):
        flat.where(f"field_id = '{name}'").coalesce(1).write.mode("append").parquet(folder)
    query = snapshots.diagnose(spark, folder, lambda b: transfer.spectral_flux(b, G2, binning=P.LinearBinning(1.0), m=2, method="fft"), out, str(tmp_path / "check"), 1)
    query.awaitTermination(120)
    close(values(spark.read.parquet(out), "field_id", "shell"), values(got, "field_id", "shell"))


def test_input_checks(spark):
    df = spark.createDataFrame([("f", 0, 0, 0, 1.0), ("f", 1, 0, 0, 1.0), ("f", 0, 0, 1, 1.0)], "field_id string, i0 int, i1 int, c int, value double")
    with pytest.raises(ValueError):
        fields.check_velocity(df, G2)
    even = spark.createDataFrame([(0.0, 5.0), (0.5, 5.0), (1.0, 5.0)], "x0 double, x1 double")
    assert fields.check_uniform(even, 2) == [0.5, 0.0] and fields.domain_size(even, 2) == [1.5, 1.0]
    with pytest.raises(ValueError):
        fields.check_uniform(spark.createDataFrame([(0.0,), (0.4,), (1.0,)], "x0 double"), 1)


def test_new_invariant(flat):
    class Doubled(P.KineticEnergy):
        pass

    density.register(Doubled, lambda c, n, k: 2 * density._dot(c, n), lambda c, n, k: 2 * density._dot_array(c, n))
    one = values(transfer.spectral_flux(flat, G2), "field_id", "shell")
    for method in ("sql", "fft"):
        close({k: v / 2 for k, v in values(transfer.spectral_flux(flat, G2, invariant=Doubled(), method=method), "field_id", "shell").items()}, one)


def complexes(df, *keys):
    return {tuple(r[k] for k in keys): complex(r["re"], r["im"]) for r in df.collect()}


def test_packed_and_long_fields_are_the_same(spark, flat):
    keys = ("field_id", "i0", "i1", "c")
    packed = stack.pack(flat.withColumn("i2", flat["i2"]), G2, 2)
    assert packed.count() == 2 and stack.components(packed, G2) == 2
    long = complexes(stack.unpack(packed, G2), *keys)
    own = complexes(flat, *keys)
    assert len(long) == 2 * 288 and all(abs(long[k] - own.get(k, 0)) < 1e-15 for k in long)
    close(values(transfer.spectral_flux(packed, G2, method="fft"), "field_id", "shell"), values(transfer.spectral_flux(flat, G2), "field_id", "shell"))
    term = complexes(stack.unpack(nonlinear.nonlinear_term(packed, G2, method="fft"), G2), *keys)
    joined = complexes(nonlinear.nonlinear_term(flat, G2), *keys)
    assert all(abs(term[k] - joined.get(k, 0)) < 1e-12 for k in term)
    # many fields, rows of a field in any order, some of them twice, an id that is null
    rows = [(None if i == 5 else f"f{i:03}", (i + j) % 12, j % 12, j % 2, float(i), float(-j)) for i in range(300) for j in (3, 7, 3)]
    many = spark.createDataFrame(rows, "field_id string, i0 int, i1 int, c int, re double, im double").repartition(7)
    got = {r["field_id"]: (np.array(r["re"]), np.array(r["im"])) for r in stack.pack(many, G2, 2).collect()}
    assert len(got) == 300 and stack.pack(many.limit(0), G2, 2).count() == 0
    for i in (0, 5, 299):
        re, im = got[None if i == 5 else f"f{i:03}"]
        want = np.zeros((2, 12, 12))
        for j in (3, 7, 3):
            want[j % 2, (i + j) % 12, j % 12] += i
        assert (re == want.ravel()).all() and im.sum() == -13


def test_blocks_of_modes_change_nothing(flat):
    keys = ("field_id", "i0", "i1")
    wide = [{tuple(r[k] for k in keys): r["r1"] for r in nonlinear.wide_term(flat, flat, G2, 2, block=b).collect()} for b in (512, 10)]
    close(*wide, tol=1e-12)


def test_modes_are_made_once(spark):
    """The source's only aggregate is run once for all that reads its modes."""
    df = spark.createDataFrame([("f", i, j, 0, float(i * j)) for i in range(12) for j in range(12)], "field_id string, i0 int, i1 int, c int, value double")
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    M.release()
    u = fields.streamfunction_velocity(T.forward(df.mapInArrow(count, df.schema), G2, "sql"), G2)
    assert transfer.spectral_flux(u, G2, binning=P.LinearBinning(1.0), m=2).count() == 9
    assert seen.value == 144
    M.release()


def test_open_families(spark, flat):
    class Halves:
        def edges_to(self, k_max):
            return [0.0, 1.5, 2.5, k_max + 1]

        def centers(self, edges):
            return [10.0, 20.0, 30.0]

    class Narrow:  # a dealiasing rule of one's own
        def keeps(self, n):
            return [min(i, n - i) < 3 for i in range(n)]

        def length(self, n):
            return n

    class Odd(Narrow):  # modes that aren't the nearest to zero
        def keeps(self, n):
            return [i in (0, 1, 3, n - 3, n - 1) for i in range(n)]

    class Cut:
        def column(self, k, scale):
            from pyspark.sql import functions as F

            return F.when(k < scale, 1.0).otherwise(0.0)

        def array(self, k, scale):
            return (k < scale).astype(float)

    for rule in (Narrow(), Odd()):
        rows = [transfer.spectral_flux(flat, G2, binning=Halves(), dealiasing=rule, method=m) for m in ("sql", "fft")]
        close(*(values(r, "field_id", "shell", "k_shell") for r in rows))
        assert {r["k_shell"] for r in rows[0].collect()} == {10.0, 20.0, 30.0}
    kept = T.apply_filter(flat, G2, Cut(), 2.0).where("re <> 0").collect()
    assert kept and all(min(r["i0"], 12 - r["i0"]) ** 2 + min(r["i1"], 12 - r["i1"]) ** 2 < 4 for r in kept)
    assert coarse.flux_map(T.inverse(flat, G2, "fft"), G2, Cut(), 2.0).count() == 288


def test_triadic_values_are_those_of_the_whole_product():
    rng = np.random.default_rng(7)
    z = lambda *n: rng.normal(size=n) + 1j * rng.normal(size=n)
    for states, blocks in ((4, 9), (9, 4)):
        a, b, w = z(states, blocks), z(states, blocks), rng.random(states) + 0.5
        u, s, v = tod.triadic_svd(b, a, w, blocks)
        root = np.sqrt(w)[:, None]
        whole = (root * a) @ (root * b).conj().T / blocks
        assert np.allclose(s, np.linalg.svd(whole, compute_uv=False)[: len(s)]) and len(s) == min(states, blocks)
        assert np.allclose((root * u) * s @ (root * v).conj().T, whole)
    u, s, v = tod.triadic_svd(np.zeros((3, 4), complex), z(3, 4), np.ones(3), 4)
    assert len(s) == 0


def test_fold_keeps_the_order(spark):
    import pandas as pd

    df = spark.createDataFrame([(f"f{i:04}", j, float(i)) for i in range(200) for j in range(3)], "field_id string, i0 int, value double").repartition(5)
    run = lambda p: pd.DataFrame({"field_id": p["field_id"].iloc[:1], "text": [p["field_id"].iloc[0]]})
    got = batch.batch_map(df, run, "field_id string, text string", lambda a, b: a.assign(text=a["text"].iloc[0] + b["text"].iloc[0]))
    assert got["text"].iloc[0] == "".join(f"f{i:04}" for i in range(200))


def test_blocks_of_points(spark):
    g = P.Grid((5, 4))
    rng = np.random.default_rng(2)
    u = rng.normal(size=(5, 4, 1)) + 1j * rng.normal(size=(5, 4, 1))
    x = rng.uniform(-3, 3, size=(60, 2))
    places = spark.createDataFrame([("f", i, float(a), float(b)) for i, (a, b) in enumerate(x)], "field_id string, point long, x0 double, x1 double")
    k = np.stack(np.meshgrid(spectral.axis(5), spectral.axis(4), indexing="ij"), -1).reshape(-1, 2)
    want = {(i,): float((np.exp(1j * k @ p) * u.ravel()).sum().real) for i, p in enumerate(x)}
    for block in (4096, 7):
        close(values(T.scattered_inverse(modes(spark, {"f": u}, g), places, g, block), "point", value="value"), want)


def test_known_values(spark):
    from eddyscale.plans.queries import QUERIES

    got = {r["shell"]: r["transfer"] for r in QUERIES["flux_kinetic"](spark, "/root/testdata/sf0.01").collect()}
    assert np.allclose([got[n] for n in range(1, 6)], [0, -0.227943, 0.724083, -0.963046, 0.466906], atol=1e-6)


@pytest.mark.parametrize("name", ["flux_kinetic", "mode_to_mode_fft", "flux_partial_helmholtz_fft", "total_energy_budget_fft", "tod_leading", "tod_coefficients", "batch_flux", "spherical_coefficients", "coarse_mean_wet", "flux_3d_pencil", "tod_tree", "tod_auxiliary", "coarse_masked", "coarse_scattered_fast", "flux_padded_even", "shell_to_shell_spherical", "dealiasing_masks", "tapers", "shells_logarithmic"])
def test_sql_agrees(spark, name):
    import duckdb

    from eddyscale.plans.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("lineitem", "events", "embeddings", "supplier"):
        con.sql(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    ours, theirs = QUERIES[name](spark, "/root/testdata/sf0.001").toPandas(), con.sql(ORACLE_SQL[name]).df()
    columns = sorted(ours.columns)
    keys = [c for c in columns if ours[c].dtype != float]
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs)
    a, b = (x[columns].sort_values(keys or columns).reset_index(drop=True) for x in (ours, theirs))
    assert (a[keys] == b[keys]).all().all() and np.allclose(a.drop(columns=keys), b.drop(columns=keys), atol=1e-6)
