"""A batch of snapshots: one function for each, then gathered, summed, averaged or folded."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def batch_map(fields: DataFrame, run: Callable[[pd.DataFrame], pd.DataFrame], schema: str, how: str | Callable = "gather", keys: tuple[str, ...] = (), item: str = "field_id"):
    """``run`` on each item's rows, in parallel over items.

    gather: the rows of all items, in the items' order; sum, mean: of every other column, by
    ``keys``; a function of two frames (associative): folded over the items' results in order,
    first within each range of items where they are, then over the ranges' results on the driver.
    """
    got = fields.groupBy(item).applyInPandas(run, schema)
    if how == "gather":
        return got.orderBy(item, *keys)
    if how in ("sum", "mean"):
        values = [c for c in got.columns if c not in (item, *keys)]
        agg = F.sum if how == "sum" else F.avg
        return got.groupBy(*keys).agg(*(agg(c).alias(c) for c in values))
    if callable(how):
        return _folded(got, how, item)
    raise ValueError(f"how: {how!r}")


def _folded(got: DataFrame, how: Callable, item: str) -> pd.DataFrame:
    from pyspark import TaskContext
    from pyspark.sql.types import IntegerType, StructField, StructType

    names = got.columns

    def run(batches):
        total = rest = None

        def add(frames):
            nonlocal total
            for _, own in frames:
                own = own.reset_index(drop=True)
                total = own if total is None else how(total, own)

        for pdf in batches:
            rest = pdf if rest is None else pd.concat([rest, pdf])
            last = rest[item] == rest[item].iloc[-1] if len(rest) else []
            add(rest[~last].groupby(item, sort=True) if len(rest) else [])  # the last item may go on
            rest = rest[last] if len(rest) else rest
        if rest is not None and len(rest):
            add(rest.groupby(item, sort=True))
        if total is not None:
            yield total[names].assign(__part=TaskContext.get().partitionId())

    parts = int(got.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = StructType([*got.schema.fields, StructField("__part", IntegerType())])
    some = got.repartitionByRange(parts, item).sortWithinPartitions(item).mapInPandas(run, schema).toPandas()
    return reduce(how, [own[names].reset_index(drop=True) for _, own in some.groupby("__part", sort=True)])


def spread(fields: DataFrame, parts: int) -> DataFrame:
    """Fields dealt over ``parts`` partitions, whole: what a process grid is elsewhere."""
    if parts < 1:
        raise ValueError("parts must be positive")
    return fields.repartition(parts, "field_id")
