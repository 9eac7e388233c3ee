"""Fields from the supplied tables, readers and writers of the fixed schemas, and input checks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import spectral
from ..operators import modes as M
from ..operators import transforms as T
from ..plans.types import Grid


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_modes(spark: SparkSession, path: str, form: str = "parquet") -> DataFrame:
    return spark.read.format(form).schema(M.MODES).load(path)


def write(df: DataFrame, path: str, form: str = "parquet", by: str | None = None) -> None:
    """Results as files, optionally a folder for each field."""
    writer = df.write.mode("overwrite").format(form)
    (writer.partitionBy(by) if by else writer).save(path)


def gridded(rows: DataFrame, grid: Grid, keys: list[Column], values: list[Column], field: str | Column = "f") -> DataFrame:
    """Points (field_id, i0.., c, value): sums of ``values`` where ``keys``, modulo the grid, fall."""
    at = [F.pmod(k, F.lit(n)).cast("int").alias(f"i{d}") for d, (k, n) in enumerate(zip(keys, grid.ns, strict=True))]
    name = F.lit(field) if isinstance(field, str) else field
    sums = rows.groupBy(name.alias("field_id"), *at).agg(*(F.sum(v).alias(f"v{c}") for c, v in enumerate(values)))
    parts = F.array(*(F.struct(F.lit(c).alias("c"), F.col(f"v{c}").cast("double").alias("value")) for c in range(len(values))))
    return sums.select(*M.place(grid), F.explode(parts).alias("p")).select(*M.place(grid), "p.c", "p.value")


def streamfunction_velocity(psi: DataFrame, grid: Grid) -> DataFrame:
    """(i ky psi, -i kx psi) of component 0: two-dimensional and solenoidal."""
    kx, ky = spectral.wavenumbers(grid)
    re, im = F.col("re"), F.col("im")
    parts = F.array(F.struct(F.lit(0).alias("c"), (-ky * im).alias("re"), (ky * re).alias("im")), F.struct(F.lit(1).alias("c"), (kx * im).alias("re"), (-kx * re).alias("im")))
    return psi.where("c = 0").select(*M.place(grid), F.explode(parts).alias("p")).select(*M.place(grid), "p.c", "p.re", "p.im")


def potential_velocity(potential: DataFrame, grid: Grid) -> DataFrame:
    """i k x A of components 0..2: three-dimensional and solenoidal."""
    from ..operators.density import curl

    wide = M.widen(potential, grid, 3, [])
    made = curl([(F.col(f"r{c}"), F.col(f"m{c}")) for c in range(3)], spectral.wavenumbers(grid))
    parts = F.array(*(F.struct(F.lit(c).alias("c"), re.alias("re"), im.alias("im")) for c, (re, im) in enumerate(made)))
    return wide.select(*M.place(grid), F.explode(parts).alias("p")).select(*M.place(grid), "p.c", "p.re", "p.im")


def lineitem_points(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """Quantity, price and discount of order lines on a grid of order, part (and supplier) keys."""
    keys = [F.col(k) for k in ("l_orderkey", "l_partkey", "l_suppkey")[: grid.nd]]
    values = [F.col("l_quantity") / 10, F.col("l_extendedprice") / 10_000, F.col("l_discount") * 10]
    return gridded(table(spark, sf_dir, "lineitem"), grid, keys, values)


def lineitem_velocity(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    """A solenoidal velocity: of a streamfunction in two dimensions, of a potential in three."""
    points = lineitem_points(spark, sf_dir, grid)
    if grid.nd == 2:
        return streamfunction_velocity(T.forward(points.where("c = 0"), grid), grid)
    return potential_velocity(T.forward(points, grid), grid)


def lineitem_scalar(spark: SparkSession, sf_dir: str, grid: Grid) -> DataFrame:
    return T.forward(lineitem_points(spark, sf_dir, grid).where("c = 1").withColumn("c", F.lit(0)), grid)


def embedding_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a one-dimensional field of 64 points."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("field_id"), F.posexplode("embedding").alias("i0", "value"))
    return rows.select("field_id", "i0", F.lit(0).alias("c"), F.col("value").cast("double").alias("value"))


def embedding_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same fields packed, a row each."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("field_id"), F.col("embedding").cast("array<double>").alias("re"))
    return rows.withColumn("im", F.transform("re", lambda x: F.lit(0.0)))


def event_series(spark: SparkSession, sf_dir: str, nt: int, nx: int) -> DataFrame:
    """Summed event values, in thousands, and their logarithms by event number and user: (t, var, x, value), every cell present."""
    rows = table(spark, sf_dir, "events").select(F.pmod("event_id", F.lit(nt)).cast("long").alias("t"), F.pmod("user_id", F.lit(nx)).cast("int").alias("x"), F.array(F.col("value"), F.log1p(F.abs("value"))).alias("v"))
    long = rows.select("t", "x", F.posexplode("v").alias("var", "value")).groupBy("t", "var", "x").agg((F.sum("value") / 1000).alias("value"))
    cells = spectral_cells(spark, nt, nx)
    return cells.join(long, ["t", "var", "x"], "left").na.fill(0.0, ["value"])


def spectral_cells(spark: SparkSession, nt: int, nx: int, nvar: int = 2) -> DataFrame:
    one = lambda n, name: F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name)
    return spark.range(nt).select(F.col("id").alias("t"), one(nvar, "var")).select("t", "var", one(nx, "x"))


# --- checks -------------------------------------------------------------------------------------


def domain_size(coordinates: DataFrame, nd: int) -> list[float]:
    """Length of each axis: points times spacing, from least, greatest and number of distinct coordinates."""
    stats = coordinates.agg(*(f(f"x{d}").alias(f"{n}{d}") for d in range(nd) for f, n in ((F.min, "lo"), (F.max, "hi"), (F.countDistinct, "n")))).first()
    return [stats[f"n{d}"] * (stats[f"hi{d}"] - stats[f"lo{d}"]) / (stats[f"n{d}"] - 1) if stats[f"n{d}"] > 1 else 1.0 for d in range(nd)]


def check_uniform(coordinates: DataFrame, nd: int, tolerance: float = 1e-8) -> list[float]:
    """The spacing of each axis; an error where neighbours are spaced unevenly."""
    out = []
    for d in range(nd):
        own = coordinates.select(F.col(f"x{d}").alias("x")).distinct()
        ends = own.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
        if ends["n"] < 2:
            out.append(0.0)
            continue
        step = (ends["hi"] - ends["lo"]) / (ends["n"] - 1)
        # each value against the multiple of the spacing that it should be: no order, so no single task
        at = F.round((F.col("x") - ends["lo"]) / step)
        off = own.agg(F.max(F.abs(F.col("x") - ends["lo"] - at * step)).alias("worst"), F.count_distinct(at).alias("n")).first()
        if 2 * off["worst"] > tolerance * abs(step) + tolerance or off["n"] < ends["n"]:
            raise ValueError(f"axis {d} isn't uniform: off by {off['worst']}")
        out.append(step)
    return out


def check_velocity(points: DataFrame, grid: Grid) -> None:
    """At least one component, as many as axes, each with every point of the grid."""
    counts = {r["c"]: r["n"] for r in points.groupBy("c").agg(F.countDistinct(*M.IDS[: grid.nd]).alias("n")).collect()}
    if not counts:
        raise ValueError("no components")
    if len(counts) < grid.nd:
        raise ValueError(f"{len(counts)} components in {grid.nd} dimensions")
    if len(set(counts.values())) > 1:
        raise ValueError("components differ in size")


def circle(n: int, length: float = 2 * math.pi) -> list[float]:
    return [i * length / n for i in range(n)]
