"""Whole fields as arrays, many at a time: the form in which numpy transforms them.

Packed: field_id, keys, re array<double>, im array<double>; an array holds all components, each
a whole grid in row order.  A packed field is one row, so a batch of fields is a map without a
shuffle; long modes are packed by one shuffle on the field.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType

from ..plans.types import Grid

#: Complex numbers of all components that a stack holds, about.
STACK = 1 << 17


def is_packed(df: DataFrame) -> bool:
    return "re" in df.columns and isinstance(df.schema["re"].dataType, ArrayType)


def components(packed: DataFrame, grid: Grid) -> int:
    row = packed.select(F.size("re").alias("n")).limit(1).collect()
    return row[0]["n"] // grid.size if row else 0


def pack(modes: DataFrame, grid: Grid, m: int, keys: list[str] | None = None, values: tuple[str, ...] = ("re", "im")) -> DataFrame:
    """Long rows (field_id, keys, i0.., c, values) as packed ones; rows of one place are summed."""
    own = ["field_id", *(keys or [])]
    places = [f"i{d}" for d in range(grid.nd)]
    rows = modes.where(F.col("c") < m).select(*own, *(F.col(p).cast("int").alias(p) for p in places), F.col("c").cast("int").alias("c"), *(F.col(v).cast("double").alias(v) for v in values))
    dealt = rows.repartition(*own).sortWithinPartitions(*own)
    schema = StructType([*dealt.select(*own).schema.fields, *StructType.fromDDL(", ".join(f"{v} array<double>" for v in values)).fields])

    def ends(table: pa.Table) -> np.ndarray:
        """The row after each run of one field."""
        new = np.zeros(max(table.num_rows - 1, 0), bool)
        for name in own:
            column = table.column(name).combine_chunks()
            differs = pc.not_equal(column.slice(1), column.slice(0, len(column) - 1))
            nulls = pc.not_equal(column.is_null().slice(1), column.is_null().slice(0, len(column) - 1))
            new |= pc.or_(pc.fill_null(differs, False), nulls).to_numpy(zero_copy_only=False)
        return np.append(np.flatnonzero(new) + 1, table.num_rows)

    def run(batches):
        held: pa.Table | None = None
        step = max(1, STACK // (m * grid.size))

        def packed(table: pa.Table, stops: np.ndarray):
            for at in range(0, len(stops), step):
                some = stops[at : at + step]
                first = int(stops[at - 1]) if at else 0
                part = table.slice(first, int(some[-1]) - first)
                starts = np.concatenate(([0], some[:-1] - first)).astype(np.int64)
                which = np.repeat(np.arange(len(some)), np.diff(np.append(starts, part.num_rows)))
                flat = part.column("c").to_numpy().astype(np.int64)
                for p, n in zip(places, grid.ns, strict=True):
                    flat = flat * n + part.column(p).to_numpy()
                flat += which * (m * grid.size)
                size = len(some) * m * grid.size
                offsets = pa.array(np.arange(len(some) + 1) * (m * grid.size), pa.int32())
                arrays = [pa.ListArray.from_arrays(offsets, pa.array(np.bincount(flat, part.column(v).to_numpy(), size))) for v in values]
                yield pa.RecordBatch.from_arrays([*(part.column(n).combine_chunks().take(pa.array(starts)) for n in own), *arrays], names=[*own, *values])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            stops = ends(held)
            if len(stops) > step:  # the last field may go on in the next batch
                yield from packed(held.slice(0, int(stops[-2])), stops[:-1])
                held = held.slice(int(stops[-2]))
        if held is not None and held.num_rows:
            yield from packed(held, ends(held))

    return dealt.mapInArrow(run, schema)


def unpack(packed: DataFrame, grid: Grid, keys: list[str] | None = None) -> DataFrame:
    """Long rows of every mode and component."""
    own = ["field_id", *(keys or [])]
    rows = packed.select(*own, F.posexplode(F.arrays_zip("re", "im")).alias("pos", "z"))
    at, out = F.col("pos"), []
    for d in range(grid.nd - 1, -1, -1):
        out.append((at % grid.ns[d]).cast("int").alias(f"i{d}"))
        at = F.floor(at / grid.ns[d])
    return rows.select(*own, *out[::-1], at.cast("int").alias("c"), F.col("z.re").alias("re"), F.col("z.im").alias("im"))


def ready(modes: DataFrame, grid: Grid, m: int, keys: list[str] | None = None) -> DataFrame:
    """Packed, whichever form it has."""
    return modes if is_packed(modes) else pack(modes, grid, m, keys)


def together(sides: dict[str, DataFrame], keys: dict[str, list[str]] | None = None) -> DataFrame:
    """Packed sides of one field in one row: re_name, im_name and each side's keys."""
    out = None
    for name, df in sides.items():
        one = df.select("field_id", *((keys or {}).get(name, [])), F.col("re").alias(f"re_{name}"), F.col("im").alias(f"im_{name}"))
        out = one if out is None else out.join(one, "field_id")
    return out


def _array(batch: pa.RecordBatch, name: str, grid: Grid) -> np.ndarray:
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1, *grid.ns)


def mapped(rows: DataFrame, grid: Grid, sides: list[str], keys: list[str], made: str, run: Callable, width: int = 1) -> DataFrame:
    """``run`` on stacks of the sides' complex arrays (field, component, place..).

    It gives for each name of the schema ``made`` an array whose first axis is the field: of two
    axes for columns of arrays, or of rows that are repeated for the field's keys.  ``width``:
    how many times the fields' size ``run`` needs in memory.
    """
    own = ["field_id", *keys]
    fields = StructType.fromDDL(made).fields
    schema = StructType([*rows.select(*own).schema.fields, *fields])
    lists = [isinstance(f.dataType, ArrayType) for f in fields]
    kinds = {"int": pa.int32(), "double": pa.float64(), "bigint": pa.int64()}

    def go(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            size = len(batch.column(batch.schema.get_field_index(f"re_{sides[0]}")).flatten()) // batch.num_rows
            step = max(1, STACK // max(1, size * width))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = run(*(_array(part, f"re_{s}", grid) + 1j * _array(part, f"im_{s}", grid) for s in sides))
                columns, repeat = [], 1
                for f, whole in zip(fields, lists, strict=True):
                    value = np.ascontiguousarray(got[f.name])
                    if whole:
                        value = value.reshape(part.num_rows, -1)
                        columns.append(pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1) * value.shape[1], pa.int32()), pa.array(value.ravel())))
                    else:
                        repeat = value.shape[1]
                        columns.append(pa.array(value.ravel(), kinds[f.dataType.simpleString()]))
                take = pa.array(np.repeat(np.arange(part.num_rows), repeat))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(n)).take(take) for n in own), *columns], names=[*own, *(f.name for f in fields)])

    return rows.mapInArrow(go, schema)


def constant(values, fields: int) -> np.ndarray:
    """The same row of values for every field."""
    return np.broadcast_to(np.asarray(values), (fields, len(values)))
