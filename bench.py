"""Times the headline queries once each, after a warm-up; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

HEADLINE = ["flux_kinetic", "flux_kinetic_fft", "flux_3d", "shell_to_shell", "shell_to_shell_fft", "band_to_band", "mode_to_mode", "flux_partial_helmholtz", "coarse_gaussian", "tod_budget", "batch_flux", "total_energy_budget"]


#: Rows of the published table: grid points along an axis, fields in the batch.
SIZES = ((32, 16384), (64, 4096), (128, 1024))


def fields(spark, n: int, count: int):
    """A batch of solenoidal velocities, a packed row each, kept in memory as arrays are elsewhere."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        k = np.fft.fftfreq(n, 1 / n)
        kx, ky = np.meshgrid(k, k, indexing="ij")
        for batch in batches:
            for seed in batch.column(0).to_pylist():
                psi = np.fft.fftn(np.random.default_rng(seed).normal(size=(n, n))) / n**2
                u = np.stack([1j * ky * psi, -1j * kx * psi]).ravel()
                yield pa.RecordBatch.from_arrays([pa.array([str(seed)]), pa.array([u.real]), pa.array([u.imag])], names=["field_id", "re", "im"])

    made = spark.range(0, count, 1, 64).mapInArrow(run, "field_id string, re array<double>, im array<double>").cache()
    made.count()
    return made


def timed(df) -> float:
    began = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - began


def published(spark) -> dict[str, float]:
    """Milliseconds a field over a batch, for the rows and sizes of the published table; the better of two runs."""
    from eddyscale.operators import nonlinear, stack, transfer
    from eddyscale.plans import types as P

    out, bins = {}, P.LinearBinning(1.0)
    for n, count in SIZES:
        grid, some = P.Grid((n, n)), fields(spark, n, count)
        runs = {
            "nonlinear_fft": lambda m, g=grid: nonlinear.nonlinear_term(m, g, method="fft", m=2),
            "flux": lambda m, g=grid: transfer.spectral_flux(m, g, binning=bins, method="fft", m=2),
            "shell_to_shell": lambda m, g=grid: transfer.shell_to_shell(m, g, binning=bins, method="fft", m=2).matrix,
        }
        for name, run in runs.items():
            own = some.limit(count // 4).repartition(64).cache() if name == "shell_to_shell" else some
            rows = own.count()
            out[f"{name}_{n}_ms_per_field"] = round(min(timed(run(own)) for _ in range(2)) * 1000 / rows, 3)
        if n == 32:
            few = some.limit(64).repartition(16).cache()
            few.count()
            out["mode_to_mode_32_ms_per_field"] = round(min(timed(transfer.mode_to_mode(few, grid, force=True, dense=True, method="fft", m=2).pairs) for _ in range(2)) * 1000 / 64, 3)
            long = stack.unpack(few.limit(8), grid).cache()
            long.count()
            out["nonlinear_direct_32_ms_per_field"] = round(timed(nonlinear.nonlinear_term(long, grid, m=2)) * 1000 / 8, 3)
        spark.catalog.clearCache()
    return out


def main() -> None:
    from pyspark.sql import SparkSession

    from eddyscale.plans.queries import QUERIES

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["flux_kinetic"](spark, sf_dir).collect()
    times = {}
    for name in HEADLINE:
        spark.catalog.clearCache()  # nothing of an earlier query is used again
        began = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total of headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "per_field": published(spark)}))
    spark.stop()


if __name__ == "__main__":
    main()
