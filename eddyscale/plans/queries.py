"""The registered queries of the transfer engine, each with SQL that computes it another way.

The SQL takes the direct route through physical space: inverse transform, product, forward
transform.  The engine joins modes by their triad, or transforms stacks of fields.  Doubles are
rounded on both sides, since sums run in different orders; cells of any size are compared.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import spectral
from ..operators import batch, coarse, decompose, density, masked, nonlinear, pencil, shells, sphere, tod, transfer
from ..operators import modes as M
from ..operators import transforms as T
from ..sources import fields
from . import dispatch
from . import types as P

DIGITS = 7
FLAT, ODD, CUBE, SMALL = P.Grid((12, 12)), P.Grid((11, 11)), P.Grid((9, 9, 9)), P.Grid((8, 8))


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*((F.round(c.name, DIGITS) + F.lit(0.0)).alias(c.name) if isinstance(c.dataType, DoubleType) else F.col(c.name) for c in df.schema))


def _q(run, drop=("field_id",)):
    def query(s, d):
        M.release()  # what an earlier query has kept
        return rounded(run(s, d).drop(*drop))

    return query


def _u(s, d, grid=FLAT):
    return fields.lineitem_velocity(s, d, grid)


def _th(s, d, grid=FLAT):
    return fields.lineitem_scalar(s, d, grid)


# --- SQL ----------------------------------------------------------------------------------------


class Sql:
    """Common table expressions over one grid."""

    def __init__(self, grid: P.Grid):
        self.grid, self.n, self.nd, self.size = grid, grid.ns[0], grid.nd, grid.size
        self.parts: list[str] = []
        d, n = range(self.nd), self.n
        self.ids = ", ".join(f"i{a}" for a in d)
        keys = ["l_orderkey", "l_partkey", "l_suppkey"]
        self.add("ax", f"SELECT CAST(r AS INTEGER) AS i, CAST(CASE WHEN r <= {n // 2} THEN r ELSE r - {n} END AS DOUBLE) AS k, least(r, {n} - r) < {n // 3} AS keep FROM range({n}) t(r)")
        self.add("gr", f"SELECT {', '.join(f'a{x}.i AS i{x}, a{x}.k AS k{x}' for x in d)}, sqrt({' + '.join(f'a{x}.k * a{x}.k' for x in d)}) AS kap, {' AND '.join(f'a{x}.keep' for x in d)} AS keep FROM {', '.join(f'ax a{x}' for x in d)}")
        self.add("pt", f"SELECT {', '.join(f'CAST({keys[x]} % {n} AS INTEGER) AS x{x}' for x in d)}, sum(l_quantity / 10) AS v0, sum(l_extendedprice / 10000) AS v1, sum(l_discount * 10) AS v2 FROM lineitem GROUP BY ALL")
        self.add("ph", f"SELECT g.*, {', '.join(f'sum(v{c} * cos({self.angle("g.i", "x")})) / {n**self.nd} AS r{c}, -sum(v{c} * sin({self.angle("g.i", "x")})) / {n**self.nd} AS m{c}' for c in range(3))} FROM gr g, pt GROUP BY ALL")
        if self.nd == 2:
            self.add("uh", "SELECT i0, i1, 0 AS c, -k1 * m0 AS re, k1 * r0 AS im FROM ph UNION ALL SELECT i0, i1, 1, k0 * m0, -k0 * r0 FROM ph")
        else:
            one = lambda c, a, b: f"SELECT {self.ids}, {c} AS c, -(k{a} * m{b} - k{b} * m{a}) AS re, k{a} * r{b} - k{b} * r{a} AS im FROM ph"
            self.add("uh", " UNION ALL ".join(one(*x) for x in ((0, 1, 2), (1, 2, 0), (2, 0, 1))))
        self.add("th", f"SELECT {self.ids}, 0 AS c, r1 AS re, m1 AS im FROM ph")
        if self.nd == 2:  # quantity and price as a velocity, as they are
            self.add("vh", f"SELECT {self.ids}, 0 AS c, r0 / 100 AS re, m0 / 100 AS im FROM ph UNION ALL SELECT {self.ids}, 1, r1 / 100, m1 / 100 FROM ph")

    def add(self, name: str, query: str) -> None:
        self.parts.append(f"{name} AS MATERIALIZED ({query})")

    def angle(self, a: str, b: str) -> str:
        return f"2 * pi() * ({' + '.join(f'{a}{x} * {b}{x} / {n}.0' for x, n in enumerate(self.grid.ns))})"

    def term(self, name: str, u: str = "uh", f: str = "uh", keys: tuple[str, ...] = (), u_keys: tuple[str, ...] = (), keep: bool = True) -> str:
        """Table ``name``: modes of the nonlinear term by keys."""
        d, size = range(self.nd), self.size
        places = ", ".join(f"x.i{a} AS x{a}" for a in d)
        xs, also = ", ".join(f"x{a}" for a in d), "".join(f", {k}" for k in keys)
        more = "".join(f", {k}" for k in u_keys)
        where = "WHERE q.keep" if keep else ""
        turn = self.angle("q.i", "x.i")
        self.add(f"{name}_u", f"SELECT {places}, c{more}, sum(re * cos({turn}) - im * sin({turn})) / {size} AS v FROM {u} JOIN gr q USING ({self.ids}), gr x {where} {'AND' if keep else 'WHERE'} c < {self.nd} GROUP BY ALL")
        slopes = ", ".join(f"sum(-q.k{a} * im * cos({turn}) - q.k{a} * re * sin({turn})) / {size} AS g{a}" for a in d)
        self.add(f"{name}_g", f"SELECT {places}, c{also}, {slopes} FROM {f} JOIN gr q USING ({self.ids}), gr x {where} GROUP BY ALL")
        pick = " ".join(f"WHEN {a} THEN g{a}" for a in d)
        self.add(f"{name}_n", f"SELECT {xs}, g.c{also}{more}, sum(u.v * CASE u.c {pick} END) AS v FROM {name}_u u JOIN {name}_g g USING ({xs}) GROUP BY ALL")
        turn = self.angle("k.i", "n.x")
        self.add(name, f"SELECT {', '.join(f'k.i{a}' for a in d)}, c{also}{more}, sum(v * cos({turn})) / {size} AS re, -sum(v * sin({turn})) / {size} AS im FROM {name}_n n, gr k {'WHERE k.keep' if keep else ''} GROUP BY ALL")
        return name

    def curled(self, name: str, of: str, keys: tuple[str, ...] = ()) -> str:
        also = "".join(f", {k}" for k in keys)
        pick = ", ".join(f"sum(re) FILTER (WHERE c = {c}) AS r{c}, sum(im) FILTER (WHERE c = {c}) AS m{c}" for c in range(self.nd))
        self.add(f"{name}_w", f"SELECT {self.ids}{also}, {', '.join(f'k{a}' for a in range(self.nd))}, {pick} FROM {of} JOIN gr USING ({self.ids}) GROUP BY ALL")
        one = lambda c, a, b: f"SELECT {self.ids}{also}, {c} AS c, -(k{a} * m{b} - k{b} * m{a}) AS re, k{a} * r{b} - k{b} * r{a} AS im FROM {name}_w"
        self.add(name, " UNION ALL ".join(one(*x) for x in ([(0, 0, 1)] if self.nd == 2 else [(0, 1, 2), (1, 2, 0), (2, 0, 1)])))
        return name

    def density(self, name: str, carrier: str, term: str, keys: tuple[str, ...] = ()) -> str:
        also = "".join(f", {k}" for k in keys)
        self.add(name, f"SELECT {self.ids}{also}, sum(a.re * b.re + a.im * b.im) AS t FROM {carrier} a JOIN {term} b USING ({self.ids}, c) GROUP BY ALL")
        return name

    def edges(self, binning, geometry=P.ShellMagnitude()) -> list[float]:  # noqa: B008
        edges = shells.shell_edges(binning, spectral.largest(self.grid, geometry))
        rows = ", ".join(f"({n + 1}, {edges[n]!r}::DOUBLE, {edges[n + 1]!r}::DOUBLE, {c!r}::DOUBLE)" for n, c in enumerate(shells.shell_centers(binning, edges)))
        self.add("ed", f"SELECT * FROM (VALUES {rows}) v(n, lo, hi, center)")
        dims = geometry.dims if geometry.dims is not None else range(self.nd)
        self.add("sh", f"SELECT {self.ids}, n AS shell FROM gr JOIN ed ON sqrt({' + '.join(f'k{d} * k{d}' for d in dims)}) >= lo AND sqrt({' + '.join(f'k{d} * k{d}' for d in dims)}) < hi")
        return edges

    def done(self, query: str) -> str:
        return "WITH " + ",\n".join(self.parts) + "\n" + query


def _r(x: str) -> str:
    return f"round({x}, {DIGITS}) + 0.0"


def _flux_sql(grid, binning, geometry=P.ShellMagnitude(), f="uh", invariant="ke", keep=True, u="uh", q: Sql | None = None) -> str:  # noqa: B008
    q = q or Sql(grid)
    term, carrier = q.term("nl", u=u, f=f, keep=keep), f
    if invariant in ("helicity", "enstrophy"):
        carrier = q.curled("cw", f)
    if invariant == "enstrophy":
        term = q.curled("nw", term)
    q.density("t", carrier, term)
    q.edges(binning, geometry)
    q.add("s", f"SELECT shell, sum(t) AS t FROM t JOIN sh USING ({q.ids}) GROUP BY ALL")
    return q.done(f"SELECT CAST(n AS INTEGER) AS shell, {_r('center')} AS k_shell, {_r('coalesce(t, 0)')} AS transfer, {_r('sum(coalesce(t, 0)) OVER (ORDER BY n)')} AS flux FROM ed LEFT JOIN s ON shell = n")


def _shell_sql(f="uh", what="matrix", u="uh", q: Sql | None = None, keep: bool = True) -> str:
    q = q or Sql(FLAT)
    q.edges(P.LinearBinning(1.0))
    q.add("fm", f"SELECT f.*, shell AS m FROM {f} f JOIN sh USING ({q.ids})")
    q.density("t", f, q.term("nl", u=u, f="fm", keys=("m",), keep=keep), ("m",))
    q.add("s", f"SELECT shell AS n, m, sum(t) AS t FROM t JOIN sh USING ({q.ids}) GROUP BY ALL")
    q.add("mx", "SELECT a.n, b.n AS m, a.lo, a.hi, a.center, coalesce(t, 0) AS t FROM ed a CROSS JOIN ed b LEFT JOIN s ON s.n = a.n AND s.m = b.n")
    return q.done({
        "matrix": f"SELECT CAST(n AS INTEGER) AS n, CAST(m AS INTEGER) AS m, {_r('t')} AS transfer FROM mx",
        "net": f"SELECT CAST(n AS INTEGER) AS n, {_r('lo')} AS lo, {_r('hi')} AS hi, {_r('center')} AS center, {_r('sum(t)')} AS net FROM mx GROUP BY n, lo, hi, center",
        "error": f"SELECT {_r('max(abs(a.t + b.t))')} AS max_antisymmetry_error FROM mx a JOIN mx b ON a.n = b.m AND a.m = b.n",
    }[what])


def _band_sql(bands: P.SmoothBands, what: str = "matrix") -> str:
    q = Sql(FLAT)
    rows = ", ".join(f"({n + 1}, {float(c)!r}::DOUBLE)" for n, c in enumerate(bands.centers))
    q.add("raw", f"SELECT {q.ids}, b, CASE WHEN kap > 0 THEN exp(-pow(ln(kap / c), 2) / {2 * bands.logwidth**2!r}) ELSE 0 END AS w FROM gr, (VALUES {rows}) v(b, c)")
    q.add("w", f"SELECT {q.ids}, b, CASE WHEN sum(w) OVER (PARTITION BY {q.ids}) > 0 THEN w / sum(w) OVER (PARTITION BY {q.ids}) ELSE 0 END AS w FROM raw")
    q.add("fb", f"SELECT {q.ids}, c, re * w AS re, im * w AS im, b AS m FROM uh JOIN w USING ({q.ids})")
    q.density("t", "uh", q.term("nl", f="fb", keys=("m",)), ("m",))
    q.add("mx", f"SELECT CAST(b AS INTEGER) AS n, CAST(m AS INTEGER) AS m, sum(t * w) AS t FROM t JOIN w USING ({q.ids}) GROUP BY b, m")
    return q.done({
        "matrix": f"SELECT n, m, {_r('t')} AS transfer FROM mx",
        "net": f"SELECT n, {_r('c')} AS lo, {_r('c')} AS hi, {_r('c')} AS center, {_r('sum(t)')} AS net FROM mx JOIN (VALUES {rows}) v(n, c) USING (n) GROUP BY n, c",
        "error": f"SELECT {_r('max(abs(a.t + b.t))')} AS max_antisymmetry_error FROM mx a JOIN mx b ON a.n = b.m AND a.m = b.n",
    }[what])


def _mode_sql(f="uh", net: bool = False, u="uh", q: Sql | None = None, keep: bool = True) -> str:
    """Every two modes, those that nothing joins as well."""
    q = q or Sql(FLAT)
    q.add("fp", f"SELECT f.*, i0 AS p0, i1 AS p1 FROM {f} f JOIN gr USING ({q.ids}) {'WHERE keep' if keep else ''}")
    q.density("t", f, q.term("nl", u=u, f="fp", keys=("p0", "p1"), keep=keep), ("p0", "p1"))
    q.add("al", "SELECT k.i0 AS k0, k.i1 AS k1, p.i0 AS p0, p.i1 AS p1, coalesce(t, 0) AS s FROM gr k CROSS JOIN gr p LEFT JOIN t ON t.i0 = k.i0 AND t.i1 = k.i1 AND t.p0 = p.i0 AND t.p1 = p.i1")
    return q.done(f"SELECT k0, k1, {_r('1000 * sum(s)')} AS net_milli FROM al GROUP BY k0, k1" if net else f"SELECT k0, k1, p0, p1, {_r('1000 * s')} AS s_milli FROM al")


def _milli(df: DataFrame) -> DataFrame:
    """The last column in thousandths: single modes' values are small."""
    name = df.columns[-1]
    return df.select(*df.columns[:-1], (1000 * F.col(name)).alias(f"{name}_milli"))


_CROSS = {0: (1, 2), 1: (2, 0), 2: (0, 1)}


def _parts(q: Sql, kind: str) -> str:
    """Table of a velocity's parts: component, indices, c, re, im."""
    nd = q.nd
    pick = ", ".join(f"sum(re) FILTER (WHERE c = {c}) AS r{c}, sum(im) FILTER (WHERE c = {c}) AS m{c}" for c in range(nd))
    q.add("wide", f"SELECT {q.ids}, {', '.join(f'k{a}' for a in range(nd))}, kap, {pick} FROM uh JOIN gr USING ({q.ids}) GROUP BY ALL")
    along = lambda s: f"CASE WHEN kap > 0 THEN ({' + '.join(f'k{j} * {s}{j}' for j in range(nd))}) / (kap * kap) ELSE 0 END"
    rows = []
    if kind == "helmholtz":
        for c in range(nd):
            rows.append(f"SELECT 'divergent' AS part, {q.ids}, {c} AS c, k{c} * ({along('r')}) AS re, k{c} * ({along('m')}) AS im FROM wide")
            rows.append(f"SELECT 'rotational' AS part, {q.ids}, {c} AS c, r{c} - k{c} * ({along('r')}) AS re, m{c} - k{c} * ({along('m')}) AS im FROM wide")
    if kind == "helical":
        for part, sign in (("positive", "-"), ("negative", "+")):
            other = "+" if sign == "-" else "-"
            for c, (a, b) in _CROSS.items():
                rows.append(f"SELECT '{part}' AS part, {q.ids}, {c} AS c, CASE WHEN kap > 0 THEN (r{c} - k{c} * ({along('r')}) {sign} (k{a} * m{b} - k{b} * m{a}) / kap) / 2 ELSE 0 END AS re, CASE WHEN kap > 0 THEN (m{c} - k{c} * ({along('m')}) {other} (k{a} * r{b} - k{b} * r{a}) / kap) / 2 ELSE 0 END AS im FROM wide")
    if kind == "toroidal":
        flat, tall = "k0 * k0 + k1 * k1", "kap * sqrt(k0 * k0 + k1 * k1)"
        one = [f"CASE WHEN {flat} > 0 THEN k1 / sqrt({flat}) ELSE 1 END", f"CASE WHEN {flat} > 0 THEN -k0 / sqrt({flat}) ELSE 0 END", "0"]
        two = [f"CASE WHEN {flat} > 0 THEN k0 * k2 / ({tall}) ELSE 0 END", f"CASE WHEN {flat} > 0 THEN k1 * k2 / ({tall}) ELSE 1 END", f"CASE WHEN {flat} > 0 THEN -({flat}) / ({tall}) ELSE 0 END"]
        for part, e in (("toroidal", one), ("poloidal", two)):
            dot = lambda s, e=e: " + ".join(f"({e[j]}) * {s}{j}" for j in range(3))
            for c in range(3):
                rows.append(f"SELECT '{part}' AS part, {q.ids}, {c} AS c, CASE WHEN kap > 0 THEN ({e[c]}) * ({dot('r')}) ELSE 0 END AS re, CASE WHEN kap > 0 THEN ({e[c]}) * ({dot('m')}) ELSE 0 END AS im FROM wide")
    q.add("parts", " UNION ALL ".join(rows))
    return "parts"


def _energy_sql(grid, kind) -> str:
    q = Sql(grid)
    _parts(q, kind)
    return q.done(f"SELECT part AS component, c, {_r('sum(re * re + im * im)')} AS energy, {_r('sum(re * (1 + i0) + im * (2 + i1))')} AS moment FROM parts GROUP BY part, c")


def _part_flux_sql(grid, kind, carriers_only: bool) -> str:
    q = Sql(grid)
    _parts(q, kind)
    q.edges(P.LinearBinning(1.0))
    if carriers_only:
        q.density("t", "(SELECT part AS component, * EXCLUDE (part) FROM parts)", q.term("nl"), ("component",))
        names = ["component"]
    else:
        q.add("pu", "SELECT part AS s_p, * EXCLUDE (part) FROM parts")
        q.add("pf", "SELECT part AS s_q, * EXCLUDE (part) FROM parts")
        q.density("t", "(SELECT part AS s_k, * EXCLUDE (part) FROM parts)", q.term("nl", u="pu", f="pf", keys=("s_q",), u_keys=("s_p",)), ("s_k", "s_p", "s_q"))
        names = ["s_k", "s_p", "s_q"]
    cols = ", ".join(names)
    q.add("s", f"SELECT {cols}, shell, sum(t) AS t FROM t JOIN sh USING ({q.ids}) GROUP BY ALL")
    every = ", ".join(f"(SELECT DISTINCT part AS {n} FROM parts)" for n in names)
    q.add("al", f"SELECT {cols}, n AS shell, center, coalesce(t, 0) AS t FROM (SELECT * FROM ed, {every}) e LEFT JOIN s ON s.shell = e.n AND {' AND '.join(f's.{n} = e.{n}' for n in names)}".replace(f"SELECT {cols}, n", f"SELECT {', '.join(f'e.{n}' for n in names)}, n"))
    return q.done(f"SELECT {cols}, CAST(shell AS INTEGER) AS shell, {_r('center')} AS k_shell, {_r('t')} AS transfer, {_r(f'sum(t) OVER (PARTITION BY {cols} ORDER BY shell)')} AS flux FROM al")


def _coarse_sql(response: str, what: str = "map") -> str:
    """Flux map of the velocity (v0, v1) on the points, by filtered transforms."""
    q = Sql(FLAT)
    n2 = q.n**2
    q.add("vp", "SELECT i0 AS x0, i1 AS x1, coalesce(v0, 0) / 100 AS a, coalesce(v1, 0) / 100 AS b FROM gr LEFT JOIN pt ON i0 = x0 AND i1 = x1")
    q.add("pr", "SELECT x0, x1, unnest(['u', 'v', 'uu', 'uv', 'vv']) AS w, unnest([a, b, a * a, a * b, b * b]) AS v FROM vp")
    t = q.angle("g.i", "p.x")
    q.add("fh", f"SELECT i0, i1, k0, k1, w, ({response}) * sum(v * cos({t})) / {n2} AS re, -({response}) * sum(v * sin({t})) / {n2} AS im FROM pr p, gr g GROUP BY i0, i1, k0, k1, kap, w")
    t = q.angle("f.i", "x.i")
    q.add("sm", f"SELECT x.i0, x.i1, w, sum(re * cos({t}) - im * sin({t})) AS v, sum(-f.k0 * im * cos({t}) - f.k0 * re * sin({t})) AS d0, sum(-f.k1 * im * cos({t}) - f.k1 * re * sin({t})) AS d1 FROM fh f, gr x GROUP BY ALL")
    one = lambda w, v: f"max({v}) FILTER (WHERE w = '{w}')"
    q.add("al", f"SELECT i0, i1, {one('u', 'v')} AS u, {one('v', 'v')} AS v, {one('uu', 'v')} AS uu, {one('uv', 'v')} AS uv, {one('vv', 'v')} AS vv, {one('u', 'd0')} AS ux, {one('u', 'd1')} AS uy, {one('v', 'd0')} AS vx, {one('v', 'd1')} AS vy FROM sm GROUP BY ALL")
    q.add("fx", "SELECT i0, i1, -((uu - u * u) * ux + (vv - v * v) * vy + (uv - u * v) * (uy + vx)) AS flux FROM al")
    return q.done({
        "map": f"SELECT i0, i1, {_r('flux')} AS flux FROM fx",
        "mean": f"SELECT {_r('avg(flux)')} AS mean_flux FROM fx",
        "wet": f"SELECT {_r('avg(flux)')} AS mean_flux FROM fx WHERE (i0 + i1) % 3 <> 0",
    }[what])


def _masked_sql() -> str:
    """Filtered quantities over the filtered mask, on wet cells, and the quotients' gradients."""
    q = Sql(FLAT)
    n2, response = q.n**2, "exp(-kap * kap * 4 / 24)"
    q.add("vp", "SELECT i0 AS x0, i1 AS x1, CASE WHEN (i0 + i1) % 3 <> 0 THEN 1.0::DOUBLE ELSE 0 END AS w, coalesce(v0, 0) / 100 AS a, coalesce(v1, 0) / 100 AS b FROM gr LEFT JOIN pt ON i0 = x0 AND i1 = x1")
    q.add("pr", "SELECT x0, x1, unnest(['w', 'u', 'v', 'uu', 'uv', 'vv']) AS w, unnest([w, w * a, w * b, w * a * a, w * a * b, w * b * b]) AS v FROM vp")
    t = q.angle("g.i", "p.x")
    q.add("fh", f"SELECT i0, i1, k0, k1, w, ({response}) * sum(v * cos({t})) / {n2} AS re, -({response}) * sum(v * sin({t})) / {n2} AS im FROM pr p, gr g GROUP BY i0, i1, k0, k1, kap, w")
    t = q.angle("f.i", "x.i")
    q.add("sm", f"SELECT x.i0, x.i1, w, sum(re * cos({t}) - im * sin({t})) AS v, sum(-f.k0 * im * cos({t}) - f.k0 * re * sin({t})) AS d0, sum(-f.k1 * im * cos({t}) - f.k1 * re * sin({t})) AS d1 FROM fh f, gr x GROUP BY ALL")
    one = lambda w, v: f"max({v}) FILTER (WHERE w = '{w}')"
    q.add("al", f"SELECT i0, i1, {', '.join(f'{one(w, v)} AS {w}_{v}' for w in ('w', 'u', 'v', 'uu', 'uv', 'vv') for v in ('v', 'd0', 'd1'))} FROM sm GROUP BY ALL")
    q.add("qu", "SELECT i0, i1, u_v / w_v AS u, v_v / w_v AS v, uu_v / w_v AS uu, uv_v / w_v AS uv, vv_v / w_v AS vv, " + ", ".join(f"({c}_d{j} - {c}_v / w_v * w_d{j}) / w_v AS {c}{'xy'[j]}" for c in "uv" for j in (0, 1)) + " FROM al")
    q.add("fx", "SELECT i0, i1, -((uu - u * u) * ux + (vv - v * v) * vy + (uv - u * v) * (uy + vx)) AS flux FROM qu")
    return q.done(f"SELECT i0, i1, (i0 + i1) % 3 <> 0 AS wet, {_r('CASE WHEN (i0 + i1) % 3 <> 0 THEN flux ELSE 0 END')} AS flux FROM fx")


def _filter_rows(s, d):
    """Modes along the first axis through each filter."""
    k = spectral.magnitude(FLAT)
    kinds = (("sharp", P.SharpSpectralFilter()), ("gauss", P.GaussianFilter()), ("tophat", P.TopHatFilter()))
    return _th(s, d).where("i1 = 0").select("i0", *((F.col(part) * spectral.filter_response(kind, k, 1.0)).alias(f"{n}_{part}") for n, kind in kinds for part in ("re", "im")))


_RESPONSES = {"sharp": "CASE WHEN kap < pi() THEN 1.0::DOUBLE ELSE 0 END", "gauss": "exp(-kap * kap / 24)", "tophat": "CASE WHEN kap = 0 THEN 1.0::DOUBLE ELSE sin(kap / 2) / (kap / 2) END"}


def _grid_rows(s, d):
    """What a grid's columns make of a scalar's modes."""
    k, kappa = spectral.wavenumbers(FLAT), spectral.magnitude(FLAT)
    _, edges = shells.edges_of(FLAT, P.LinearBinning(1.0))
    weights = spectral.band_weights(P.SmoothBands((1.0, 2.0, 4.0)), kappa)
    return _th(s, d).select("i0", "i1", k[0].cast("double").alias("k0"), k[1].cast("double").alias("k1"), kappa.alias("kappa"), shells.shell_of(kappa, edges).alias("shell"), spectral.two_thirds(FLAT).alias("keep"), spectral.dealiasing_mask(FLAT).alias("mask"), *((F.get(weights, F.lit(b)) * F.col("re")).alias(f"re{b}") for b in range(3)))


def _mask_energy(s, d):
    """Energy inside and outside of both kinds of two thirds."""
    return _u(s, d).groupBy(spectral.two_thirds(FLAT).alias("keep"), spectral.dealiasing_mask(FLAT).alias("mask"), spectral.dealiasing_mask(FLAT, "half").alias("half")).agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"))


_GRID_SQL = Sql(FLAT)
_GRID_SQL.edges(P.LinearBinning(1.0))
_BAND = "CASE WHEN kap > 0 THEN exp(-pow(ln(kap / {c}), 2) / 0.72) ELSE 0 END"
_BANDS = [_BAND.format(c=float(c)) for c in (1, 2, 4)]
_GRID_SQL = _GRID_SQL.done(
    f"SELECT i0, i1, {_r('k0')} AS k0, {_r('k1')} AS k1, {_r('kap')} AS kappa, CAST(coalesce(shell, 0) AS INTEGER) AS shell, keep, least(i0, 12 - i0) < 4.0 AND least(i1, 12 - i1) < 4.0 AS mask, "
    + ", ".join(f"{_r(f'CASE WHEN kap > 0 THEN re * ({b}) / ({" + ".join(f"({x})" for x in _BANDS)}) ELSE 0 END')} AS re{n}" for n, b in enumerate(_BANDS))
    + " FROM gr LEFT JOIN sh USING (i0, i1) JOIN th USING (i0, i1)"
)


def _series(s, d):
    return fields.event_series(s, d, 64, 3)


_TOD = tod.parameters(64, 16, 8, 1.0)
_HAMMING = "0.54 - 0.46 * cos(2 * pi() * (t - s) / {last})"


def _tod_base(p: tod.Parameters, taper: str = _HAMMING, off: str = "0") -> str:
    """Frequencies z of tapered blocks of the events' series, less ``off`` at each place."""
    n, norm = p.nfft, repr(float(p.window.mean() * p.nfft))
    blocks = ", ".join(f"({b}, {x})" for b, x in enumerate(tod.block_starts(p.nt, p)))
    return f"""WITH e AS (SELECT CAST(event_id % 64 AS BIGINT) AS t, CAST(user_id % 3 AS INTEGER) AS x, value FROM events),
l0 AS (SELECT t, 0 AS var, x, sum(value) / 1000 AS v FROM e GROUP BY ALL UNION ALL SELECT t, 1, x, sum(ln(1 + abs(value))) / 1000 FROM e GROUP BY ALL),
l AS (SELECT t, var, x, v - ({off}) AS v FROM l0),
b AS (SELECT * FROM (VALUES {blocks}) q(block, s)),
w AS (SELECT var, x, block, t - s AS j, v * ({taper.format(last=n - 1)}) AS v FROM l JOIN b ON t >= s AND t < s + {n}),
f AS (SELECT CAST(r AS INTEGER) AS f FROM range({-(n // 2)}, {n - n // 2}) q(r)),
z AS (SELECT var, x, block, f, sum(v * cos(2 * pi() * f * j / {n})) / {norm} AS re, -sum(v * sin(2 * pi() * f * j / {n})) / {norm} AS im FROM w, f GROUP BY ALL)
"""


_TOD_BASE = _tod_base(_TOD)
_BLOCK_COLUMNS = f"SELECT var, x, CAST(block AS INTEGER) AS block, f, {_r('re')} AS re, {_r('im')} AS im FROM z"
_HANN = tod.parameters(64, spectral.taper("hann", 16), 8, 1.0)
_TUKEY = tod.parameters(64, spectral.taper("tukey", 16, 0.5), 8, 1.0)
_HANN_SQL = "0.5 - 0.5 * cos(2 * pi() * (t - s) / {last})"
_TUKEY_SQL = "CASE WHEN least(t - s, 15 - t + s) >= 3.75 THEN 1.0::DOUBLE ELSE 0.5 - 0.5 * cos(pi() * least(t - s, 15 - t + s) / 3.75) END"


def _tod_budget(s, d, **options):
    got = tod.tod(_series(s, d), window=16, noverlap=8, dt=1.0, outputs=("bispectrum",), **options)
    return got.bispectrum.groupBy("l", "n").agg(F.sum("budget").alias("budget"), F.sum(F.col("lambda") * F.col("lambda")).alias("energy"))


#: Of all modes kept, budgets add up to the trace of the cross product and squared values to its norm.
_TOD_PAIRS = """, tr AS (SELECT a.f AS l, b.f AS n FROM f a, f b WHERE b.f >= 0 AND b.f - a.f BETWEEN -8 AND 7),
p AS (SELECT l, n, k.block, k.var, k.x, k.re * o.re - k.im * o.im AS re, k.re * o.im + k.im * o.re AS im FROM tr JOIN z o ON o.f = l JOIN z k ON k.f = n - l AND k.var = o.var AND k.x = o.x AND k.block = o.block)"""
_TOD_CROSS = f""",
c AS (SELECT p.l, p.n, p.var, p.x, q.var AS var2, q.x AS x2, sum(p.re * q.re + p.im * q.im) / {_TOD.blocks} AS re, sum(p.im * q.re - p.re * q.im) / {_TOD.blocks} AS im FROM p JOIN z q ON q.f = p.n AND q.block = p.block GROUP BY ALL)
"""
_TOD_SQL = _TOD_BASE + _TOD_PAIRS + _TOD_CROSS + f"""SELECT l, n, {_r('coalesce(sum(re) FILTER (WHERE var = var2 AND x = x2), 0)')} AS budget, {_r('sum(re * re + im * im)')} AS energy FROM c GROUP BY l, n"""


#: Frequencies as above of blocks less their mean; the mean itself stays at frequency 0.
_TOD_BLOCKWISE = _TOD_BASE.replace("\nf AS (SELECT", """
w0 AS (SELECT var, x, block, j, v FROM w),
wm AS (SELECT var, x, b.block, l.t - s AS j, (v - avg(v) OVER (PARTITION BY var, x, b.block)) * (0.54 - 0.46 * cos(2 * pi() * (l.t - s) / 15)) AS v FROM l JOIN b ON t >= s AND t < s + 16),
f AS (SELECT""").replace("FROM w, f GROUP BY ALL)", "FROM (SELECT w0.*, TRUE AS still FROM w0 UNION ALL SELECT *, FALSE FROM wm) w JOIN f ON still = (f.f = 0) GROUP BY ALL)")
#: Of two states, the squared values are the two roots of the cross product's characteristic polynomial.
_TOD_TWO = _TOD_BASE.replace("user_id % 3", "user_id % 2").replace(" UNION ALL SELECT t, 1, x, sum(ln(1 + abs(value))) / 1000 FROM e GROUP BY ALL", "") + _TOD_PAIRS + _TOD_CROSS + f""",
g AS (SELECT l, n, sum(re * re + im * im) AS t2,
  max(re) FILTER (WHERE x = 0 AND x2 = 0) AS ar, max(im) FILTER (WHERE x = 0 AND x2 = 0) AS ai, max(re) FILTER (WHERE x = 0 AND x2 = 1) AS br, max(im) FILTER (WHERE x = 0 AND x2 = 1) AS bi,
  max(re) FILTER (WHERE x = 1 AND x2 = 0) AS cr, max(im) FILTER (WHERE x = 1 AND x2 = 0) AS ci, max(re) FILTER (WHERE x = 1 AND x2 = 1) AS dr, max(im) FILTER (WHERE x = 1 AND x2 = 1) AS di FROM c GROUP BY l, n),
r AS (SELECT l, n, t2, pow(ar * dr - ai * di - br * cr + bi * ci, 2) + pow(ar * di + ai * dr - br * ci - bi * cr, 2) AS d2 FROM g)
SELECT l, n, CAST(0 AS INTEGER) AS mode, {_r('sqrt((t2 + sqrt(greatest(t2 * t2 - 4 * d2, 0))) / 2)')} AS value FROM r"""


def _tod_two(s, d):
    """The leading value of each triad of two states."""
    got = tod.tod(fields.event_series(s, d, 64, 2).where("var = 0"), window=16, noverlap=8, dt=1.0, nmode=1)
    return got.bispectrum.select("l", "n", "mode", F.col("lambda").alias("value"))


def _tod_blockwise(s, d):
    got = tod.tod(_series(s, d), window=16, noverlap=8, dt=1.0, mean_type="blockwise", outputs=("bispectrum",))
    return got.bispectrum.groupBy("l", "n").agg(F.sum("budget").alias("budget"), F.sum(F.col("lambda") * F.col("lambda")).alias("energy"))


def _tod_coefficients(s, d):
    """Of as many modes as states, coefficients hold all of the products: their squares by block."""
    got = tod.tod(_series(s, d), window=16, noverlap=8, dt=1.0, return_coefficients=True, outputs=("bispectrum",))
    return got.coefficients.where("kind = 'convective' and n > 0 and l not in (0, -8) and n - l not in (0, -8)").groupBy("l", "n", "block").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"))


#: Values that a mean is given by, by variable and place.
_MEANS = [[0.5 * (x + 1), 0.01 * (x + 1)] for x in range(3)]


def _tod_auxiliary(s, d):
    """Donor shapes, weighted by their values: as many modes as states hold all of a receiver's space."""
    got = tod.tod(_series(s, d), window=16, noverlap=8, dt=1.0, return_coefficients=True, return_auxiliary_modes=True, places=2, edge=5)
    donors = got.modes.where("kind = 'donor' and n > 0 and l not in (0, -8) and n - l not in (0, -8)")
    joined = donors.join(got.bispectrum, ["l", "n", "mode"])
    return joined.groupBy("l", "n", F.col("state").alias("var"), "x").agg(F.sum((F.col("re") * F.col("re") + F.col("im") * F.col("im")) * F.col("lambda") * F.col("lambda")).alias("energy"))


_TOD_AUXILIARY = f""", tr AS (SELECT a.f AS l, b.f AS n FROM f a, f b WHERE b.f > 0 AND b.f - a.f BETWEEN -8 AND 7 AND a.f NOT IN (0, -8) AND b.f - a.f NOT IN (0, -8)),
c AS (SELECT l, n, a.var, a.x, b.var AS var2, b.x AS x2, sum(a.re * b.re + a.im * b.im) / {_TOD.blocks} AS re, sum(a.im * b.re - a.re * b.im) / {_TOD.blocks} AS im FROM tr JOIN z a ON a.f = l JOIN z b ON b.f = n AND b.block = a.block GROUP BY ALL)
SELECT l, n, var, x, {_r('sum(re * re + im * im)')} AS energy FROM c GROUP BY l, n, var, x"""


def _tod_rank(s, d):
    """Two variables that are one: a mode a triad, all others are cut."""
    one = _series(s, d).where("var = 0")
    got = tod.tod(one.unionByName(one.withColumn("var", F.lit(1))).where("x = 0"), window=16, noverlap=8, dt=1.0, outputs=("bispectrum",))
    return got.bispectrum.groupBy("l", "n").agg(F.count("*").alias("modes"), F.sum("lambda").alias("value"))


#: Of one place, the value is the root of both sides' energies: |sum p conj(q)| over the blocks, twice for two alike variables.
_TOD_RANK = _TOD_PAIRS + f""", c AS (SELECT p.l, p.n, sum(p.re * q.re + p.im * q.im) / {_TOD.blocks} AS re, sum(p.im * q.re - p.re * q.im) / {_TOD.blocks} AS im FROM p JOIN z q ON q.f = p.n AND q.block = p.block AND q.var = p.var AND q.x = p.x WHERE p.var = 0 AND p.x = 0 GROUP BY ALL)
SELECT l, n, count(*) AS modes, {_r('sum(2 * sqrt(re * re + im * im))')} AS value FROM c GROUP BY l, n"""


def _batch_flux(s, d):
    """Each embedding as a velocity of one dimension: transfer by shell of a batch of snapshots."""
    grid = P.Grid((64,))
    return transfer.spectral_flux(T.forward(fields.embedding_stack(s, d), grid), grid, binning=P.LinearBinning(4.0), method="fft", m=1)


def _batch_flux_sql() -> str:
    turn = "2 * pi() * a.i * x.i / 64"
    return _EMB + f""",
a AS (SELECT CAST(r AS INTEGER) AS i, CASE WHEN r <= 32 THEN r ELSE r - 64 END AS k, least(r, 64 - r) < 21 AS keep FROM range(64) t(r)),
p AS (SELECT vec_id, x.i AS x, sum(re * cos({turn}) - im * sin({turn})) / 64 AS u, sum(-a.k * (im * cos({turn}) + re * sin({turn}))) / 64 AS g FROM h JOIN a USING (i), a x WHERE a.keep GROUP BY ALL),
n AS (SELECT vec_id, a.i, abs(a.k) AS k, sum(u * g * cos(2 * pi() * a.i * x / 64)) / 64 AS re, -sum(u * g * sin(2 * pi() * a.i * x / 64)) / 64 AS im FROM p, a WHERE keep GROUP BY ALL),
t AS (SELECT vec_id, 1 + CAST(floor(n.k / 4) AS INTEGER) AS shell, sum(h.re * n.re + h.im * n.im) AS t FROM n JOIN h USING (vec_id, i) GROUP BY ALL),
s AS (SELECT v.vec_id, CAST(r AS INTEGER) AS shell, coalesce(t, 0) AS t FROM (SELECT DISTINCT vec_id FROM h) v CROSS JOIN range(1, 9) q(r) LEFT JOIN t ON t.vec_id = v.vec_id AND t.shell = r)
SELECT CAST(vec_id AS VARCHAR) AS field_id, shell, {_r('4.0 * shell - 2')} AS k_shell, {_r('t')} AS transfer, {_r('sum(t) OVER (PARTITION BY vec_id ORDER BY shell)')} AS flux FROM s"""


def _batch_each(s, d):
    """Gathered: of every field its energy."""
    import numpy as np
    import pandas as pd

    run = lambda pdf: pd.DataFrame({"field_id": pdf["field_id"].iloc[:1], "energy": [float(np.mean(pdf["value"].to_numpy() ** 2))]})
    return batch.batch_map(fields.embedding_fields(s, d), run, "field_id string, energy double", "gather")


def _batch_mean(s, d):
    import pandas as pd

    run = lambda pdf: pd.DataFrame({"field_id": pdf["field_id"].iloc[0], "i0": pdf["i0"].to_numpy(), "square": pdf["value"].to_numpy() ** 2})
    return batch.batch_map(fields.embedding_fields(s, d), run, "field_id string, i0 int, square double", "mean", ("i0",))


def _batch_fold(s, d):
    """Folded in order: the largest energy, and how many fields."""
    import pandas as pd

    run = lambda pdf: pd.DataFrame({"field_id": pdf["field_id"].iloc[:1], "most": [float((pdf["value"].to_numpy() ** 2).sum())], "fields": [1]})
    both = lambda a, b: a.assign(most=max(a["most"].iloc[0], b["most"].iloc[0]), fields=a["fields"].iloc[0] + b["fields"].iloc[0])
    whole = batch.batch_map(fields.embedding_fields(s, d), run, "field_id string, most double, fields long", both)
    return s.createDataFrame([(float(whole["most"].iloc[0]), int(whole["fields"].iloc[0]))], "most double, fields long")


def _batch_sum(s, d):
    import numpy as np
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        power = np.abs(np.fft.fft(pdf.sort_values("i0")["value"].to_numpy()) / 64) ** 2
        return pd.DataFrame({"field_id": pdf["field_id"].iloc[0], "i0": np.arange(64, dtype=np.int32), "power": power})

    return batch.batch_map(fields.embedding_fields(s, d), run, "field_id string, i0 int, power double", "sum", ("i0",))


_EMB = "WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS x FROM embeddings), h AS (SELECT vec_id, i, sum(v * cos(2 * pi() * i * x / 64)) / 64 AS re, -sum(v * sin(2 * pi() * i * x / 64)) / 64 AS im FROM e, range(64) q(i) GROUP BY ALL)"


def _scatter(s, d):
    rows = fields.table(s, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    x = [(F.col("s_suppkey") % 17).cast("double"), (F.col("s_suppkey") % 23 + F.col("s_nationkey")).cast("double")]
    parts = F.array(F.struct(F.lit(0).alias("c"), (F.col("s_acctbal") / 1000).alias("value")), F.struct(F.lit(1).alias("c"), (F.col("s_nationkey") / 10.0).alias("value")))
    return rows.select(F.lit("f").alias("field_id"), F.col("s_suppkey").cast("long").alias("point"), x[0].alias("x0"), x[1].alias("x1"), F.explode(parts).alias("p")).select("field_id", "point", "x0", "x1", "p.c", "p.value")


_SCATTER = """WITH r AS (SELECT CAST(s_suppkey AS BIGINT) AS point, CAST(s_suppkey % 17 AS DOUBLE) AS x0, CAST(s_suppkey % 23 + s_nationkey AS DOUBLE) AS x1, s_acctbal / 1000 AS u, s_nationkey / 10.0 AS v FROM supplier),
m AS (SELECT min(x0) AS a0, max(x0) AS b0, min(x1) AS a1, max(x1) AS b1 FROM r),
p AS (SELECT point, CASE WHEN b0 > a0 THEN (x0 - a0) / (b0 - a0) * 2 * pi() - pi() ELSE 0 END AS x0, CASE WHEN b1 > a1 THEN (x1 - a1) / (b1 - a1) * 2 * pi() - pi() ELSE 0 END AS x1, u, v FROM r, m),
"""


def _scatter_sql() -> str:
    q = Sql(SMALL)
    grid = ",\n".join(x for x in q.parts if x.startswith(("ax ", "gr ")))
    return _SCATTER + grid + f""",
w AS (SELECT point, x0, x1, unnest(['u', 'v', 'uu', 'uv', 'vv']) AS w, unnest([u, v, u * u, u * v, v * v]) AS f FROM p),
h AS (SELECT i0, i1, k0, k1, w, exp(-kap * kap / 24) * avg(f * cos(k0 * x0 + k1 * x1)) AS re, -exp(-kap * kap / 24) * avg(f * sin(k0 * x0 + k1 * x1)) AS im FROM w, gr GROUP BY i0, i1, k0, k1, kap, w),
s AS (SELECT point, w, sum(re * cos(k0 * x0 + k1 * x1) - im * sin(k0 * x0 + k1 * x1)) AS f, sum(-k0 * (im * cos(k0 * x0 + k1 * x1) + re * sin(k0 * x0 + k1 * x1))) AS d0, sum(-k1 * (im * cos(k0 * x0 + k1 * x1) + re * sin(k0 * x0 + k1 * x1))) AS d1 FROM h, p GROUP BY ALL),
al AS (SELECT point, max(f) FILTER (WHERE w = 'u') AS u, max(f) FILTER (WHERE w = 'v') AS v, max(f) FILTER (WHERE w = 'uu') AS uu, max(f) FILTER (WHERE w = 'uv') AS uv, max(f) FILTER (WHERE w = 'vv') AS vv, max(d0) FILTER (WHERE w = 'u') AS ux, max(d1) FILTER (WHERE w = 'u') AS uy, max(d0) FILTER (WHERE w = 'v') AS vx, max(d1) FILTER (WHERE w = 'v') AS vy FROM s GROUP BY point)
SELECT point, {_r('-((uu - u * u) * ux + (vv - v * v) * vy + (uv - u * v) * (uy + vx))')} AS flux FROM al"""


def _modes_sql(term: bool) -> str:
    q = Sql(FLAT)
    name = q.term("nl") if term else "uh"
    return q.done(f"SELECT i0, i1, c, {_r('re')} AS re, {_r('im')} AS im FROM {name}")


def _padded_sql() -> str:
    """The same term without wrapping: triads whose sum leaves the grid don't count."""
    q = Sql(ODD)
    q.add("hu", "SELECT i0, i1, c, re, im, k0, k1 FROM uh JOIN gr USING (i0, i1)")
    q.add("pr", "SELECT u.k0 + f.k0 AS k0, u.k1 + f.k1 AS k1, f.c, sum((CASE u.c WHEN 0 THEN f.k0 ELSE f.k1 END) * -(u.re * f.im + u.im * f.re)) / 14641 AS re, sum((CASE u.c WHEN 0 THEN f.k0 ELSE f.k1 END) * (u.re * f.re - u.im * f.im)) / 14641 AS im FROM hu u, hu f GROUP BY ALL")
    q.add("nl", "SELECT i0, i1, c, re, im FROM pr JOIN gr USING (k0, k1)")
    q.density("t", "uh", "nl")
    q.edges(P.LinearBinning(1.0))
    q.add("s", "SELECT shell, sum(t) AS t FROM t JOIN sh USING (i0, i1) GROUP BY ALL")
    return q.done(f"SELECT CAST(n AS INTEGER) AS shell, {_r('center')} AS k_shell, {_r('coalesce(t, 0)')} AS transfer, {_r('sum(coalesce(t, 0)) OVER (ORDER BY n)')} AS flux FROM ed LEFT JOIN s ON shell = n")


def _padded_even_sql() -> str:
    """The same on an even grid: the middle stands at -6, its slope is +6, and its partner lies beyond the grid; sums wrap at 18."""
    q = Sql(FLAT)
    low = "CASE WHEN {0} < 6 THEN {0} ELSE {0} - 12 END"
    q.add("hu", f"SELECT {low.format('i0')} AS q0, {low.format('i1')} AS q1, c, re, im, k0, k1 FROM uh JOIN gr USING (i0, i1)")
    q.add("us", "SELECT q0, q1, c, sum(re) / 2 AS re, sum(im) / 2 AS im FROM (SELECT q0, q1, c, re, im FROM hu UNION ALL SELECT -q0, -q1, c, re, -im FROM hu) GROUP BY ALL")
    q.add("gs", "SELECT j, q0, q1, c, sum(re) / 2 AS re, sum(im) / 2 AS im FROM (SELECT j, q0, q1, c, s * -im * k AS re, re * k AS im FROM (SELECT *, unnest([0, 1]) AS j, unnest([k0, k1]) AS k, 1 AS s FROM hu) UNION ALL SELECT j, -q0, -q1, c, -im * k, -re * k FROM (SELECT *, unnest([0, 1]) AS j, unnest([k0, k1]) AS k FROM hu)) GROUP BY ALL")
    q.add("pr", "SELECT (u.q0 + g.q0 + 36) % 18 AS a, (u.q1 + g.q1 + 36) % 18 AS b, g.c, sum(u.re * g.re - u.im * g.im) / 20736 AS re, sum(u.re * g.im + u.im * g.re) / 20736 AS im FROM us u JOIN gs g ON u.c = g.j GROUP BY ALL")
    q.add("nl", "SELECT i0, i1, c, re, im FROM pr JOIN gr ON a = CASE WHEN i0 < 6 THEN i0 ELSE i0 + 6 END AND b = CASE WHEN i1 < 6 THEN i1 ELSE i1 + 6 END")
    q.density("t", "uh", "nl")
    q.edges(P.LinearBinning(1.0))
    q.add("s", "SELECT shell, sum(t) AS t FROM t JOIN sh USING (i0, i1) GROUP BY ALL")
    return q.done(f"SELECT CAST(n AS INTEGER) AS shell, {_r('center')} AS k_shell, {_r('coalesce(t, 0)')} AS transfer, {_r('sum(coalesce(t, 0)) OVER (ORDER BY n)')} AS flux FROM ed LEFT JOIN s ON shell = n")


def _budget_sql() -> str:
    q = Sql(FLAT)
    q.add("bh", "SELECT i0, i1, 0 AS c, -k1 * m1 AS re, k1 * r1 AS im FROM ph UNION ALL SELECT i0, i1, 1, k0 * m1, -k0 * r1 FROM ph")
    q.edges(P.LinearBinning(1.0))
    rows = []
    for n, (kind, carrier, by, of, sign) in enumerate((("kinetic", "uh", "uh", "uh", ""), ("kinetic", "uh", "bh", "bh", "-"), ("magnetic", "bh", "uh", "bh", ""), ("magnetic", "bh", "bh", "uh", "-"))):
        q.density(f"t{n}", carrier, q.term(f"n{n}", u=by, f=of))
        rows.append(f"SELECT '{kind}' AS kind, shell, {sign}t AS t FROM t{n} JOIN sh USING (i0, i1)")
    q.add("s", " UNION ALL ".join(rows))
    return q.done(f"SELECT CAST(n AS INTEGER) AS shell, {_r('center')} AS k_shell, {_r("coalesce(sum(t) FILTER (WHERE kind = 'kinetic'), 0)")} AS kinetic, {_r("coalesce(sum(t) FILTER (WHERE kind = 'magnetic'), 0)")} AS magnetic, {_r('coalesce(sum(t), 0)')} AS total FROM ed LEFT JOIN s ON shell = n GROUP BY n, center")


def _magnetic(s, d):
    return fields.streamfunction_velocity(_th(s, d), FLAT)


_BANDS4 = P.SmoothBands((1.0, 2.0, 3.0, 4.0), 0.5)
_LIN = P.LinearBinning(1.0)


def _energies(grid, kind):
    def run(s, d):
        parts = decompose.decompose(_u(s, d, grid), grid, kind, grid.nd)
        return parts.groupBy("component", "c").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("energy"), F.sum(F.col("re") * (1 + F.col("i0")) + F.col("im") * (2 + F.col("i1"))).alias("moment"))

    return run


def _velocity_points(s, d):
    """Quantity and price as the components of a velocity on the grid."""
    return fields.lineitem_points(s, d, FLAT).where("c < 2").withColumn("value", F.col("value") / 100)


def _mean_flux(wet: bool):
    def run(s, d):
        fluxes = coarse.flux_map(_velocity_points(s, d), FLAT, P.GaussianFilter(), 2.0)
        return coarse.mean_flux(fluxes.withColumn("wet", (F.col("i0") + F.col("i1")) % 3 != 0), wet="wet") if wet else coarse.mean_flux(fluxes)

    return run


def _taper_rows(s, d):
    """The first rows of a series under each taper."""
    rows = fields.event_series(s, d, 64, 3).where("t < 17 and var = 0 and x = 0").select(F.col("t").cast("int").alias("j"), "value")
    kinds = (("hamming", "hamming", 0.0), ("hann", "hann", 0.0), ("tukey", "tukey", 0.4))
    return rows.select("j", *((F.col("value") * spectral.taper_column(kind, F.col("j"), 17, alpha)).alias(name) for name, kind, alpha in kinds))


_TAPER_SQL = (
    "WITH v AS (SELECT CAST(event_id % 64 AS INTEGER) AS j, sum(value) / 1000 AS v FROM events WHERE event_id % 64 < 17 AND user_id % 3 = 0 GROUP BY 1) "
    f"SELECT CAST(r AS INTEGER) AS j, {_r('coalesce(v, 0) * (0.54 - 0.46 * cos(2 * pi() * r / 16))')} AS hamming, {_r('coalesce(v, 0) * (0.5 - 0.5 * cos(2 * pi() * r / 16))')} AS hann, "
    f"{_r('coalesce(v, 0) * CASE WHEN least(r, 16 - r) >= 3.2 THEN 1.0::DOUBLE ELSE 0.5 - 0.5 * cos(pi() * least(r, 16 - r) / 3.2) END')} AS tukey FROM range(17) q(r) LEFT JOIN v ON j = r"
)


def _shell_table(s, d, binning):
    """Shells with the variance of a scalar in each."""
    edges = shells.shell_edges(binning, spectral.largest(FLAT))
    held = _th(s, d).withColumn("shell", shells.shell_of(spectral.magnitude(FLAT), edges)).groupBy("shell").agg(F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("variance"))
    return shells.shells(s, binning, edges).join(held, "shell", "left").na.fill(0.0, ["variance"])


def _shell_table_sql(lo: str, hi: str, center: str, last: str) -> str:
    q = Sql(FLAT)
    q.add("st", f"SELECT n, {lo} AS lo, {hi} AS hi, {center} AS center FROM range(1, 40) q(n) WHERE {last}")
    return q.done(f"SELECT CAST(n AS INTEGER) AS shell, {_r('lo')} AS lo, {_r('hi')} AS hi, {_r('center')} AS center, {_r('coalesce((SELECT sum(re * re + im * im) FROM th JOIN gr USING (i0, i1) WHERE kap >= lo AND kap < hi), 0)')} AS variance FROM st")


def _density_rows(s, d):
    u = M.once(_u(s, d))
    return density.transfer_density(u, nonlinear.nonlinear_term(u, FLAT, m=2), FLAT, m=2)


def _density_sql() -> str:
    q = Sql(FLAT)
    q.density("t", "uh", q.term("nl"))
    return q.done(f"SELECT i0, i1, {_r('t')} AS t FROM t")


def _rotational(s, d):
    return decompose.decompose(_u(s, d), FLAT, P.RotationalDecomposition(), 2).drop("component")


def _rotational_points(s, d):
    """Of a velocity on the grid, the divergent part there."""
    return decompose.decompose_points(_velocity_points(s, d), FLAT, P.HelmholtzDecomposition()).where("component = 'divergent'").drop("component")


def _rotational_points_sql() -> str:
    q = Sql(FLAT)
    t = q.angle("g.i", "x.i")
    q.add("dv", "SELECT i0, i1, k0, k1, CASE WHEN kap > 0 THEN (k0 * r0 + k1 * r1) / (kap * kap) ELSE 0 END / 10 AS ar, CASE WHEN kap > 0 THEN (k0 * m0 + k1 * m1) / (kap * kap) ELSE 0 END / 10 AS am FROM (SELECT i0, i1, k0, k1, kap, r0 / 10 AS r0, m0 / 10 AS m0, r1 / 10 AS r1, m1 / 10 AS m1 FROM ph)")
    one = lambda c: f"SELECT x.i0, x.i1, {c} AS c, sum(g.k{c} * (ar * cos({t}) - am * sin({t}))) AS v FROM dv g, gr x GROUP BY ALL"
    return q.done(f"SELECT i0, i1, c, {_r('v')} AS value FROM ({one(0)} UNION ALL {one(1)})")


def _channels(s, d):
    """The velocity in channels three cells wide, with dry cells between them."""
    return _velocity_points(s, d).withColumn("wet", F.col("i0") % 4 != 3)


def _channels_sql(parts: str = "both") -> str:
    """Potential of each channel by cosines across it and exponentials along it."""
    q = Sql(FLAT)
    q.add("pv", "SELECT i0, i1, i0 // 4 AS q, i0 % 4 AS a, coalesce(v0, 0) / 100 AS u0, coalesce(v1, 0) / 100 AS u1 FROM gr LEFT JOIN pt ON i0 = x0 AND i1 = x1")
    q.add("fc", "SELECT p.i0, p.i1, p.q, p.a, CASE WHEN p.a < 2 THEN (p.u0 + x.u0) / 2 ELSE 0 END AS f0, CASE WHEN p.a < 3 THEN (p.u1 + y.u1) / 2 ELSE 0 END AS f1 FROM pv p JOIN pv x ON x.i0 = (p.i0 + 1) % 12 AND x.i1 = p.i1 JOIN pv y ON y.i0 = p.i0 AND y.i1 = (p.i1 + 1) % 12")
    q.add("bb", "SELECT p.q, p.a, p.i1 AS j, CASE WHEN p.a > 0 THEN x.f0 ELSE 0 END - p.f0 + y.f1 - p.f1 AS b FROM fc p JOIN fc x ON x.i0 = (p.i0 + 11) % 12 AND x.i1 = p.i1 JOIN fc y ON y.i0 = p.i0 AND y.i1 = (p.i1 + 11) % 12 WHERE p.a < 3")
    q.add("mk", "SELECT m, k, 4 - 2 * cos(pi() * m / 3) - 2 * cos(pi() * k / 6) AS e FROM range(3) x(m), range(12) y(k) WHERE m + k > 0")
    q.add("cf", "SELECT q, m, k, sum(b * cos(pi() * (a + 0.5) * m / 3) * cos(pi() * k * j / 6)) / any_value(e) * CASE m WHEN 0 THEN 1 ELSE 2 END / 36 AS re, -sum(b * cos(pi() * (a + 0.5) * m / 3) * sin(pi() * k * j / 6)) / any_value(e) * CASE m WHEN 0 THEN 1 ELSE 2 END / 36 AS im FROM bb, mk GROUP BY q, m, k")
    q.add("ph2", "SELECT q, a, j, sum(cos(pi() * (a + 0.5) * m / 3) * (re * cos(pi() * k * j / 6) - im * sin(pi() * k * j / 6))) AS f FROM cf, range(3) x(a), range(12) y(j) GROUP BY q, a, j")
    q.add("sl", "SELECT c.i0, c.i1, f0, f1, CASE WHEN c.a < 2 THEN x.f - p.f ELSE 0 END AS d0, CASE WHEN c.a < 3 THEN y.f - p.f ELSE 0 END AS d1 FROM fc c LEFT JOIN ph2 p ON p.q = c.q AND p.a = c.a AND p.j = c.i1 LEFT JOIN ph2 x ON x.q = c.q AND x.a = c.a + 1 AND x.j = c.i1 LEFT JOIN ph2 y ON y.q = c.q AND y.a = c.a AND y.j = (c.i1 + 1) % 12")
    every = " UNION ALL ".join(f"SELECT '{n}' AS component, i0, i1, {c} AS c, {_r(v)} AS value FROM sl" for n, v_ in (("divergent", "d{c}"), ("rotational", "f{c} - d{c}")) for c in (0, 1) for v in (v_.format(c=c),))
    return q.done(every if parts == "both" else f"SELECT * EXCLUDE (component) FROM ({every}) WHERE component = '{parts}'")


def _sphere(s, d):
    """Suppliers as points of a sphere, each as heavy as any other."""
    rows = fields.table(s, d, "supplier")
    points = rows.select(F.lit("f").alias("field_id"), ((F.col("s_suppkey") % 19 + 0.5) * (math.pi / 19)).alias("theta"), ((F.col("s_suppkey") % 23) * (2 * math.pi / 23)).alias("phi"), F.lit(0).alias("c"), (F.col("s_acctbal") / 1000).alias("value"))
    return points


def _harmonic_rows(points: str) -> str:
    """Rows (l, m, c, re, im) of value v at colatitude a and longitude b against the harmonics up to degree two."""
    return " UNION ALL ".join(
        f"SELECT {l} AS l, {m} AS m, c, ({norm}) * ({body}) * cos({m} * b) * v AS re, -({norm}) * ({body}) * sin({m} * b) * v AS im FROM {points}"
        for l, m, norm, body in (
            (0, 0, "sqrt(1 / (4 * pi()))", "1"),
            (1, -1, "sqrt(3 / (8 * pi()))", "sin(a)"),
            (1, 0, "sqrt(3 / (4 * pi()))", "cos(a)"),
            (1, 1, "-sqrt(3 / (8 * pi()))", "sin(a)"),
            (2, -2, "sqrt(15 / (32 * pi()))", "sin(a) * sin(a)"),
            (2, -1, "sqrt(15 / (8 * pi()))", "sin(a) * cos(a)"),
            (2, 0, "sqrt(5 / (16 * pi()))", "3 * cos(a) * cos(a) - 1"),
            (2, 1, "-sqrt(15 / (8 * pi()))", "sin(a) * cos(a)"),
            (2, 2, "sqrt(15 / (32 * pi()))", "sin(a) * sin(a)"),
        )
    )


_SPHERE = f"WITH p AS (SELECT 0 AS c, (s_suppkey % 19 + 0.5) * pi() / 19 AS a, (s_suppkey % 23) * 2 * pi() / 23 AS b, s_acctbal / 1000 AS v, (s_nationkey + 1) / 100.0 AS w FROM supplier), y AS ({_harmonic_rows('p')}), s AS (SELECT l, m, c, 4 * pi() * avg(re) AS re, 4 * pi() * avg(im) AS im FROM y GROUP BY ALL) "
_SPHERE_WEIGHTED = _SPHERE[: _SPHERE.index(", y AS")] + f", pw AS (SELECT c, a, b, v * w AS v FROM p), y AS ({_harmonic_rows('pw')}) SELECT l, m, c, {_r('sum(re)')} AS re, {_r('sum(im)')} AS im FROM y GROUP BY l, m, c"


def _sphere_weighted(s, d):
    """Each supplier with a weight of its own."""
    rows = fields.table(s, d, "supplier").select("s_suppkey", ((F.col("s_nationkey") + 1) / 100.0).alias("weight"))
    place = [((F.col("s_suppkey") % 19 + 0.5) * (math.pi / 19)).alias("theta"), ((F.col("s_suppkey") % 23) * (2 * math.pi / 23)).alias("phi")]
    held = fields.table(s, d, "supplier").select("s_suppkey", F.lit("f").alias("field_id"), *place, F.lit(0).alias("c"), (F.col("s_acctbal") / 1000).alias("value"))
    return sphere.spherical_analysis(held.join(rows, "s_suppkey"), 2)


def _sphere_velocity(s, d):
    """Balance and nation of suppliers as two components at points of a sphere."""
    rows = _sphere(s, d)
    nation = fields.table(s, d, "supplier").select(F.lit("f").alias("field_id"), ((F.col("s_suppkey") % 19 + 0.5) * (math.pi / 19)).alias("theta"), ((F.col("s_suppkey") % 23) * (2 * math.pi / 23)).alias("phi"), F.lit(1).alias("c"), (F.col("s_nationkey") / 10.0).alias("value"))
    return rows.unionByName(nation)


_RINGS, _LONGITUDES, _DEGREE = 5, 10, 2
_SPHERE_GRID = sphere.coefficient_grid(_DEGREE)


def _ring_points(s, d):
    """Quantity and price of order lines on rings and longitudes, by order and part."""
    return fields.lineitem_points(s, d, P.Grid((_RINGS, _LONGITUDES))).where("c < 2").withColumn("value", F.col("value") / 1000)


class SphereSql(Sql):
    """Coefficients of ``_ring_points`` on Gauss rings, as modes ``uh`` of a grid whose wavenumbers are given."""

    def __init__(self, scattered: bool = False):
        self.grid, self.n, self.nd, self.size = _SPHERE_GRID, 0, 2, _SPHERE_GRID.size
        self.parts, self.ids = [], "i0, i1"
        theta, weight = sphere.rings("gauss", _RINGS)
        self.add("rg", f"SELECT * FROM (VALUES {', '.join(f'({j}, {a!r}::DOUBLE, {w!r}::DOUBLE)' for j, (a, w) in enumerate(zip(theta.tolist(), weight.tolist(), strict=True)))}) q(j, a, w)")
        self.add("pt", f"SELECT l_orderkey % {_RINGS} AS j, l_partkey % {_LONGITUDES} AS k, sum(l_quantity / 10) / 1000 AS v0, sum(l_extendedprice / 10000) / 1000 AS v1 FROM lineitem GROUP BY ALL")
        if scattered:
            self.add("p", "SELECT (s_suppkey % 19 + 0.5) * pi() / 19 AS a, (s_suppkey % 23) * 2 * pi() / 23 AS b, unnest([0, 1]) AS c, 4 * pi() / (SELECT count(*) FROM supplier) * unnest([s_acctbal / 1000, s_nationkey / 10.0]) AS v FROM supplier")
        else:
            self.add("p", f"SELECT a, 2 * pi() * k / {_LONGITUDES} AS b, unnest([0, 1]) AS c, w * 2 * pi() / {_LONGITUDES} * unnest([v0, v1]) AS v FROM pt JOIN rg USING (j)")
        self.add("y", _harmonic_rows("p"))
        self.add("co", "SELECT l, m, c, sum(re) AS re, sum(im) AS im FROM y GROUP BY ALL")
        self.add("gr", f"SELECT CAST(a.r AS INTEGER) AS i0, CAST(b.r AS INTEGER) AS i1, CAST(a.r AS DOUBLE) AS k0, CAST(b.r AS DOUBLE) AS k1, sqrt(a.r * a.r + b.r * b.r) AS kap, TRUE AS keep FROM range({_DEGREE + 1}) a(r), range({2 * _DEGREE + 1}) b(r)")
        self.add("uh", "SELECT CAST(l AS INTEGER) AS i0, CAST(m + l AS INTEGER) AS i1, c, re, im FROM co")


def _from_sphere(method, **options):
    return lambda s, d: dispatch.from_sphere(method, _ring_points(s, d), _DEGREE, nrings=_RINGS, nphi=_LONGITUDES, kind="gauss", dealiasing=P.NoDealiasing(), **options)


def _axes_rows(s, d):
    """Spacing and length of the axes that the order lines' grid has, and how many components are whole."""
    points = fields.lineitem_points(s, d, FLAT)
    places = points.select((F.col("i0") * 0.5).alias("x0"), (F.col("i1") * 0.25).alias("x1"))
    steps, sizes = fields.check_uniform(places, 2), fields.domain_size(places, 2)
    fields.check_velocity(points, FLAT)
    return s.createDataFrame([(d_, float(a), float(b)) for d_, (a, b) in enumerate(zip(steps, sizes, strict=True))], "axis int, step double, length double").coalesce(1)


_DEFS: dict[str, tuple] = {
    "flux_kinetic": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=_LIN, m=2), _flux_sql(FLAT, _LIN)),
    "flux_kinetic_fft": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=_LIN, method="fft", m=2), _flux_sql(FLAT, _LIN)),
    "flux_enstrophy": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=_LIN, invariant=P.Enstrophy(), m=2), _flux_sql(FLAT, _LIN, invariant="enstrophy")),
    "flux_scalar": (lambda s, d: transfer.scalar_flux(_th(s, d), _u(s, d), FLAT, binning=_LIN, m=1), _flux_sql(FLAT, _LIN, f="th")),
    "flux_aliased": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=_LIN, dealiasing=P.NoDealiasing(), m=2), _flux_sql(FLAT, _LIN, keep=False)),
    "flux_padded": (lambda s, d: transfer.spectral_flux(_u(s, d, ODD), ODD, binning=_LIN, dealiasing=P.PaddedThreeHalves(), method="fft", m=2), _padded_sql()),
    "flux_log_shells": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=P.LogarithmicBinning(1.0, 1.5), m=2), _flux_sql(FLAT, P.LogarithmicBinning(1.0, 1.5))),
    "flux_dyadic_shells": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=P.DyadicBinning(0.5), m=2), _flux_sql(FLAT, P.DyadicBinning(0.5))),
    "flux_custom_shells": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=P.CustomBinning((0.0, 1.5, 2.5, 5.0)), m=2), _flux_sql(FLAT, P.CustomBinning((0.0, 1.5, 2.5, 5.0)))),
    "flux_3d": (lambda s, d: transfer.spectral_flux(_u(s, d, CUBE), CUBE, binning=_LIN, m=3), _flux_sql(CUBE, _LIN)),
    "flux_3d_helicity": (lambda s, d: transfer.spectral_flux(_u(s, d, CUBE), CUBE, binning=_LIN, invariant=P.Helicity(), m=3), _flux_sql(CUBE, _LIN, invariant="helicity")),
    "flux_3d_enstrophy": (lambda s, d: transfer.spectral_flux(_u(s, d, CUBE), CUBE, binning=_LIN, invariant=P.Enstrophy(), m=3), _flux_sql(CUBE, _LIN, invariant="enstrophy")),
    "flux_3d_perpendicular": (lambda s, d: transfer.spectral_flux(_u(s, d, CUBE), CUBE, binning=_LIN, geometry=P.perpendicular_shells(), m=3), _flux_sql(CUBE, _LIN, P.perpendicular_shells())),
    "flux_3d_parallel": (lambda s, d: transfer.spectral_flux(_u(s, d, CUBE), CUBE, binning=_LIN, geometry=P.parallel_shells(), m=3), _flux_sql(CUBE, _LIN, P.parallel_shells())),
    "flux_helmholtz_carriers": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=_LIN, decomposition=P.HelmholtzDecomposition(), m=2), _part_flux_sql(FLAT, "helmholtz", True)),
    "flux_partial_helmholtz": (lambda s, d: transfer.partial_fluxes(_u(s, d), FLAT, P.HelmholtzDecomposition(), binning=_LIN, m=2), _part_flux_sql(FLAT, "helmholtz", False)),
    "flux_partial_helical": (lambda s, d: transfer.helical_partial_fluxes(_u(s, d, CUBE), CUBE, binning=_LIN, m=3), _part_flux_sql(CUBE, "helical", False)),
    "shell_to_shell": (lambda s, d: transfer.shell_to_shell(_u(s, d), FLAT, binning=_LIN, m=2).matrix, _shell_sql()),
    "shell_to_shell_fft": (lambda s, d: transfer.shell_to_shell(_u(s, d), FLAT, binning=_LIN, method="fft", m=2).matrix, _shell_sql()),
    "shell_to_shell_net": (lambda s, d: transfer.shell_to_shell(_u(s, d), FLAT, binning=_LIN, m=2).net, _shell_sql(what="net")),
    "shell_to_shell_antisymmetry": (lambda s, d: transfer.shell_to_shell(_u(s, d), FLAT, binning=_LIN, m=2).error, _shell_sql(what="error")),
    "shell_to_shell_scalar": (lambda s, d: transfer.scalar_shell_to_shell(_th(s, d), _u(s, d), FLAT, binning=_LIN, m=1).matrix, _shell_sql("th")),
    "band_to_band": (lambda s, d: transfer.band_to_band(_u(s, d), FLAT, _BANDS4, m=2).matrix, _band_sql(_BANDS4)),
    "shell_to_shell_scalar_fft": (lambda s, d: transfer.scalar_shell_to_shell(_th(s, d), _u(s, d), FLAT, binning=_LIN, method="fft", m=1).matrix, _shell_sql("th")),
    "band_to_band_fft": (lambda s, d: transfer.band_to_band(_u(s, d), FLAT, _BANDS4, method="fft", m=2).matrix, _band_sql(_BANDS4)),
    "band_to_band_net": (lambda s, d: transfer.band_to_band(_u(s, d), FLAT, _BANDS4, m=2).net, _band_sql(_BANDS4, "net")),
    "band_to_band_antisymmetry": (lambda s, d: transfer.band_to_band(_u(s, d), FLAT, _BANDS4, m=2).error, _band_sql(_BANDS4, "error")),
    "mode_to_mode": (lambda s, d: _milli(transfer.mode_to_mode(_u(s, d), FLAT, dense=True, m=2).pairs), _mode_sql()),
    "mode_to_mode_fft": (lambda s, d: _milli(transfer.mode_to_mode(_u(s, d), FLAT, dense=True, method="fft", m=2).pairs), _mode_sql()),
    "mode_to_mode_net": (lambda s, d: _milli(transfer.mode_to_mode(_u(s, d), FLAT, dense=True, m=2).net), _mode_sql(net=True)),
    "mode_to_mode_scalar": (lambda s, d: _milli(transfer.scalar_mode_to_mode(_th(s, d), _u(s, d), FLAT, dense=True, m=1).pairs), _mode_sql("th")),
    "flux_default_shells": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT), _flux_sql(FLAT, _LIN)),
    "flux_dispatched": (lambda s, d: dispatch.from_points(P.SpectralFlux(_LIN), _velocity_points(s, d), FLAT), _flux_sql(FLAT, _LIN, f="vh", u="vh")),
    "flux_3d_fft": (lambda s, d: transfer.spectral_flux(_u(s, d, CUBE), CUBE, binning=_LIN, method="fft", m=3), _flux_sql(CUBE, _LIN)),
    "flux_3d_helicity_fft": (lambda s, d: transfer.spectral_flux(_u(s, d, CUBE), CUBE, binning=_LIN, invariant=P.Helicity(), method="fft", m=3), _flux_sql(CUBE, _LIN, invariant="helicity")),
    "flux_partial_helmholtz_fft": (lambda s, d: transfer.partial_fluxes(_u(s, d), FLAT, P.HelmholtzDecomposition(), binning=_LIN, method="fft", m=2), _part_flux_sql(FLAT, "helmholtz", False)),
    "flux_partial_helical_fft": (lambda s, d: transfer.helical_partial_fluxes(_u(s, d, CUBE), CUBE, binning=_LIN, method="fft", m=3), _part_flux_sql(CUBE, "helical", False)),
    "flux_partial_total": (lambda s, d: transfer.total_flux(transfer.partial_fluxes(_u(s, d), FLAT, P.HelmholtzDecomposition(), binning=_LIN, m=2)), _flux_sql(FLAT, _LIN)),
    "transfer_density": (_density_rows, _density_sql()),
    "nonlinear_term_fft": (lambda s, d: nonlinear.nonlinear_term(_u(s, d), FLAT, method="fft", m=2).where(spectral.two_thirds(FLAT)), _modes_sql(True)),
    "nonlinear_term": (lambda s, d: nonlinear.nonlinear_term(_u(s, d), FLAT, m=2), _modes_sql(True)),
    "forward_transform": (lambda s, d: _u(s, d), _modes_sql(False)),
    "inverse_transform": (lambda s, d: T.inverse(T.forward(fields.lineitem_points(s, d, FLAT).where("c < 2"), FLAT), FLAT), Sql(FLAT).done(f"SELECT i0, i1, c, {_r('coalesce(CASE c WHEN 0 THEN v0 ELSE v1 END, 0)')} AS value FROM (SELECT i0, i1, unnest([0, 1]) AS c FROM gr) LEFT JOIN pt ON i0 = x0 AND i1 = x1")),
    "filtered_modes": (lambda s, d: T.apply_filter(_u(s, d), FLAT, P.GaussianFilter(), 1.5), Sql(FLAT).done(f"SELECT i0, i1, c, {_r('re * exp(-kap * kap * 2.25 / 24)')} AS re, {_r('im * exp(-kap * kap * 2.25 / 24)')} AS im FROM uh JOIN gr USING (i0, i1)")),
    "grid_columns": (_grid_rows, _GRID_SQL),
    "dealiasing_masks": (_mask_energy, Sql(FLAT).done(f"SELECT keep, least(i0, 12 - i0) < 4.0 AND least(i1, 12 - i1) < 4.0 AS mask, least(i0, 12 - i0) < 6.0 AND least(i1, 12 - i1) < 6.0 AS half, {_r('sum(re * re + im * im)')} AS energy FROM uh JOIN gr USING (i0, i1) GROUP BY 1, 2, 3")),
    "filter_responses": (_filter_rows, Sql(FLAT).done("SELECT i0, " + ", ".join(f"{_r(f'{part} * ({response})')} AS {n}_{part}" for n, response in _RESPONSES.items() for part in ("re", "im")) + " FROM th JOIN gr USING (i0, i1) WHERE i1 = 0")),
    "parts_helmholtz": (_energies(FLAT, P.HelmholtzDecomposition()), _energy_sql(FLAT, "helmholtz")),
    "parts_helical": (_energies(CUBE, P.HelicalDecomposition()), _energy_sql(CUBE, "helical")),
    "parts_toroidal": (_energies(CUBE, P.ToroidalPoloidalDecomposition()), _energy_sql(CUBE, "toroidal")),
    "coarse_sharp": (lambda s, d: coarse.flux_map(_velocity_points(s, d), FLAT, P.SharpSpectralFilter(), 1.0), _coarse_sql("CASE WHEN kap < pi() THEN 1.0 ELSE 0 END")),
    "coarse_gaussian": (lambda s, d: coarse.flux_map(_velocity_points(s, d), FLAT, P.GaussianFilter(), 2.0), _coarse_sql("exp(-kap * kap * 4 / 24)")),
    "coarse_tophat": (lambda s, d: coarse.flux_map(_velocity_points(s, d), FLAT, P.TopHatFilter(), 1.0), _coarse_sql("CASE WHEN kap = 0 THEN 1.0 ELSE sin(kap / 2) / (kap / 2) END")),
    "coarse_mean": (_mean_flux(False), _coarse_sql("exp(-kap * kap * 4 / 24)", "mean")),
    "coarse_mean_wet": (_mean_flux(True), _coarse_sql("exp(-kap * kap * 4 / 24)", "wet")),
    "part_rotational": (_rotational, Sql(FLAT).done(f"SELECT i0, i1, c, {_r('re')} AS re, {_r('im')} AS im FROM uh")),
    "part_divergent_points": (_rotational_points, _rotational_points_sql()),
    "forward_transform_fft": (lambda s, d: fields.streamfunction_velocity(T.forward(fields.lineitem_points(s, d, FLAT).where("c = 0"), FLAT, "fft", 1), FLAT), _modes_sql(False)),
    "tapers": (_taper_rows, _TAPER_SQL),
    "shells_linear": (lambda s, d: _shell_table(s, d, _LIN), _shell_table_sql("n - 1", "CASE WHEN n > sqrt(72) THEN sqrt(72) ELSE n END", "(n - 1 + CASE WHEN n > sqrt(72) THEN sqrt(72) ELSE n END) / 2", "n - 1 < sqrt(72)")),
    "shells_dyadic": (lambda s, d: _shell_table(s, d, P.DyadicBinning(0.5)), _shell_table_sql("0.5 * pow(2, n - 1)", "0.5 * pow(2, n)", "0.5 * sqrt(pow(2, n - 1) * pow(2, n))", "0.5 * pow(2, n - 1) <= sqrt(72)")),
    "shells_logarithmic": (lambda s, d: _shell_table(s, d, P.LogarithmicBinning(1.0, 1.5)), _shell_table_sql("pow(1.5, n - 1)", "pow(1.5, n)", "sqrt(pow(1.5, n - 1) * pow(1.5, n))", "pow(1.5, n - 1) <= sqrt(72)")),
    "spherical_coefficients": (lambda s, d: sphere.spherical_analysis(_sphere(s, d), 2), _SPHERE + f"SELECT l, m, c, {_r('re')} AS re, {_r('im')} AS im FROM s"),
    "spherical_spectrum": (lambda s, d: sphere.spherical_spectrum(sphere.spherical_analysis(_sphere(s, d), 2)), _SPHERE + f"SELECT l, {_r('sum(re * re + im * im)')} AS energy FROM s GROUP BY l"),
    "axes_checked": (_axes_rows, f"WITH p AS (SELECT CAST(l_orderkey % 12 AS INTEGER) * 0.5 AS a, CAST(l_partkey % 12 AS INTEGER) * 0.25 AS b FROM lineitem) SELECT 0 AS axis, {_r('(max(a) - min(a)) / (count(DISTINCT a) - 1)')} AS step, {_r('count(DISTINCT a) * (max(a) - min(a)) / (count(DISTINCT a) - 1)')} AS length FROM p UNION ALL SELECT 1, {_r('(max(b) - min(b)) / (count(DISTINCT b) - 1)')}, {_r('count(DISTINCT b) * (max(b) - min(b)) / (count(DISTINCT b) - 1)')} FROM p"),
    "coarse_scattered": (lambda s, d: coarse.scattered_flux(_scatter(s, d), SMALL, P.GaussianFilter(), 1.0), _scatter_sql()),
    "tod_budget": (_tod_budget, _TOD_SQL),
    "tod_block_transform": (lambda s, d: tod.windowed_dft(_series(s, d), 64, _TOD), _TOD_BASE + _BLOCK_COLUMNS),
    "tod_blockwise": (_tod_blockwise, _TOD_BLOCKWISE + _TOD_PAIRS + _TOD_CROSS + f"SELECT l, n, {_r('coalesce(sum(re) FILTER (WHERE var = var2 AND x = x2), 0)')} AS budget, {_r('sum(re * re + im * im)')} AS energy FROM c GROUP BY l, n"),
    "tod_leading": (_tod_two, _TOD_TWO),
    "tod_coefficients": (_tod_coefficients, _TOD_BASE + _TOD_PAIRS + f" SELECT l, n, CAST(block AS INTEGER) AS block, {_r('sum(re * re + im * im)')} AS energy FROM p WHERE n > 0 AND l NOT IN (0, -8) AND n - l NOT IN (0, -8) GROUP BY l, n, block"),
    "tod_defaults": (lambda s, d: tod.windowed_dft(_series(s, d), 64, tod.parameters(64)), _tod_base(tod.parameters(64)) + _BLOCK_COLUMNS),
    "tod_hann": (lambda s, d: tod.windowed_dft(_series(s, d), 64, _HANN), _tod_base(_HANN, _HANN_SQL) + _BLOCK_COLUMNS),
    "tod_tukey": (lambda s, d: tod.windowed_dft(_series(s, d), 64, _TUKEY), _tod_base(_TUKEY, _TUKEY_SQL) + _BLOCK_COLUMNS),
    "tod_tree": (lambda s, d: _tod_budget(s, d, places=1, edge=3), _TOD_SQL),
    "tod_means": (lambda s, d: _tod_budget(s, d, mean_type=[[m[v] for m in _MEANS] for v in (0, 1)], places=2), _tod_base(_TOD, off="CASE var WHEN 0 THEN 0.5 ELSE 0.01 END * (x + 1)") + _TOD_SQL[len(_TOD_BASE) :]),
    "tod_auxiliary": (_tod_auxiliary, _TOD_BASE + _TOD_AUXILIARY),
    "tod_rank": (_tod_rank, _TOD_BASE + _TOD_RANK),
    "batch_gather": (_batch_each, _EMB + f" SELECT CAST(vec_id AS VARCHAR) AS field_id, {_r('avg(v * v)')} AS energy FROM e GROUP BY vec_id"),
    "batch_mean": (_batch_mean, _EMB + f" SELECT CAST(x AS INTEGER) AS i0, {_r('avg(v * v)')} AS square FROM e GROUP BY x"),
    "batch_fold": (_batch_fold, _EMB + f" SELECT {_r('max(p)')} AS most, count(*) AS fields FROM (SELECT sum(v * v) AS p FROM e GROUP BY vec_id)"),
    "batch_power": (_batch_sum, _EMB + f" SELECT CAST(i AS INTEGER) AS i0, {_r('sum(re * re + im * im)')} AS power FROM h GROUP BY i"),
    "batch_flux": (_batch_flux, _batch_flux_sql()),
    "flux_3d_pencil": (lambda s, d: pencil.spectral_flux(_u(s, d, CUBE), CUBE, 3, binning=_LIN, parts=3), _flux_sql(CUBE, _LIN)),
    "flux_3d_helicity_pencil": (lambda s, d: pencil.spectral_flux(_u(s, d, CUBE), CUBE, 3, binning=_LIN, invariant=P.Helicity(), parts=(2, 3, 4)), _flux_sql(CUBE, _LIN, invariant="helicity")),
    "flux_scalar_pencil": (lambda s, d: pencil.scalar_flux(_th(s, d), _u(s, d), FLAT, m=1, binning=_LIN, parts=(3, 4)), _flux_sql(FLAT, _LIN, f="th")),
    "flux_padded_pencil": (lambda s, d: pencil.spectral_flux(_u(s, d, ODD), ODD, 2, binning=_LIN, dealiasing=P.PaddedThreeHalves(), parts=2), _padded_sql()),
    "flux_padded_even": (lambda s, d: transfer.spectral_flux(_u(s, d), FLAT, binning=_LIN, dealiasing=P.PaddedThreeHalves(), method="fft", m=2), _padded_even_sql()),
    "nonlinear_term_pencil": (lambda s, d: pencil.nonlinear_term(_u(s, d), FLAT, 2, parts=3).where(spectral.two_thirds(FLAT)), _modes_sql(True)),
    "coarse_masked": (lambda s, d: coarse.masked_flux_map(_velocity_points(s, d).withColumn("wet", (F.col("i0") + F.col("i1")) % 3 != 0), FLAT, P.GaussianFilter(), 2.0, parts=3), _masked_sql()),
    "parts_dry_cells": (lambda s, d: decompose.decompose_points(_channels(s, d), FLAT, P.HelmholtzDecomposition()), _channels_sql()),
    "part_rotational_dry_cells": (lambda s, d: masked.helmholtz(_channels(s, d), FLAT, parts=(1, 2)).where("component = 'rotational'").drop("component"), _channels_sql("rotational")),
    "coarse_gaussian_pencil": (lambda s, d: coarse.masked_flux_map(_velocity_points(s, d), FLAT, P.GaussianFilter(), 2.0, parts=(2, 3)).drop("wet"), _coarse_sql("exp(-kap * kap * 4 / 24)")),
    "coarse_scattered_fast": (lambda s, d: coarse.scattered_flux(_scatter(s, d), SMALL, P.GaussianFilter(), 1.0, tolerance=1e-12), _scatter_sql()),
    "spherical_coefficients_fast": (lambda s, d: sphere.spherical_analysis(_sphere(s, d), 2, tolerance=1e-12, components=[0]), _SPHERE + f"SELECT l, m, c, {_r('re')} AS re, {_r('im')} AS im FROM s"),
    "flux_spherical_scattered": (lambda s, d: dispatch.from_sphere(P.SpectralFlux(_LIN), _sphere_velocity(s, d), _DEGREE, dealiasing=P.NoDealiasing(), tolerance=1e-12), _flux_sql(None, _LIN, keep=False, q=SphereSql(scattered=True))),
    "spherical_weighted": (_sphere_weighted, _SPHERE_WEIGHTED),
    "spherical_rings": (lambda s, d: sphere.ring_analysis(_ring_points(s, d), _RINGS, _LONGITUDES, _DEGREE, 2, "gauss", parts=2), SphereSql().done(f"SELECT CAST(l AS INTEGER) AS l, CAST(m AS INTEGER) AS m, c, {_r('re')} AS re, {_r('im')} AS im FROM co")),
    "flux_spherical": (_from_sphere(P.SpectralFlux(_LIN)), _flux_sql(None, _LIN, keep=False, q=SphereSql())),
    "shell_to_shell_spherical": (lambda s, d: _from_sphere(P.ShellToShell(_LIN))(s, d).matrix, _shell_sql(q=SphereSql(), keep=False)),
    "mode_to_mode_spherical": (lambda s, d: _milli(_from_sphere(P.ModeToMode(), dense=True)(s, d).pairs), _mode_sql(q=SphereSql(), keep=False)),
    "dispatched_shell_to_shell": (lambda s, d: dispatch.from_points(P.ShellToShell(_LIN), _velocity_points(s, d), FLAT).matrix, _shell_sql("vh", u="vh")),
    "dispatched_mode_to_mode": (lambda s, d: _milli(dispatch.from_points(P.ModeToMode(), _velocity_points(s, d), FLAT, dense=True).pairs), _mode_sql("vh", u="vh")),
    "dispatched_coarse": (lambda s, d: dispatch.from_points(P.CoarseGraining(P.GaussianFilter(), 2.0), _velocity_points(s, d), FLAT), _coarse_sql("exp(-kap * kap * 4 / 24)")),
    "dispatched_coarse_masked": (lambda s, d: dispatch.from_points(P.MaskedCoarseGraining(P.GaussianFilter(), 2.0, 2), _velocity_points(s, d).withColumn("wet", (F.col("i0") + F.col("i1")) % 3 != 0), FLAT), _masked_sql()),
    "dispatched_flux_pencil": (lambda s, d: dispatch.from_points(P.SpectralFlux(_LIN), _velocity_points(s, d), FLAT, whole=False, parts=2), _flux_sql(FLAT, _LIN, f="vh", u="vh")),
    "dispatched_tod": (lambda s, d: dispatch.calculate_energy_transfer(P.TriadicDecomposition(16, 8), _series(s, d), dt=1.0, outputs=("bispectrum",)).bispectrum.groupBy("l", "n").agg(F.sum("budget").alias("budget"), F.sum(F.col("lambda") * F.col("lambda")).alias("energy")), _TOD_SQL),
    "total_energy_budget": (lambda s, d: transfer.total_energy_budget(_u(s, d), _magnetic(s, d), FLAT, binning=_LIN), _budget_sql()),
    "total_energy_budget_fft": (lambda s, d: transfer.total_energy_budget(_u(s, d), _magnetic(s, d), FLAT, binning=_LIN, method="fft"), _budget_sql()),
}
#: Queries whose fields are told apart in the result.
_NAMED = ("batch_flux", "batch_gather")

QUERIES = {name: _q(run, () if name in _NAMED else ("field_id",)) for name, (run, _) in _DEFS.items()}
ORACLE_SQL = {name: sql for name, (_, sql) in _DEFS.items()}


def flagship(spark, sf_dir: str) -> DataFrame:
    return QUERIES["flux_kinetic"](spark, sf_dir)
