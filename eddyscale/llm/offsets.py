"""Global positions by two prefix sums: over the totals of tasks in a block, and over the blocks'.

Tasks number as many as the input's splits, so their totals are a table, not a list on the driver:
blocks of ``BLOCK`` tasks are summed side by side, and only the blocks' totals, one for about a
thousand tasks, meet in one window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import broadcast_if

BLOCK = 1024
#: Tasks whose positions are broadcast (two numbers each); beyond it they are merged.
MOST = 1 << 20


def before(totals: DataFrame, part: str = "part", total: str = "total") -> DataFrame:
    """(part, base): of each part the sum of the totals of all parts in front of it."""
    totals = totals.groupBy(part).agg(F.sum(total).alias(total)).withColumn("block", F.floor(F.col(part) / BLOCK))
    up_to = lambda w: F.coalesce(F.sum(total).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inner = totals.select(part, "block", up_to(Window.partitionBy("block").orderBy(part)).alias("inner"))
    blocks = totals.groupBy("block").agg(F.sum(total).alias(total))
    outer = blocks.select("block", up_to(Window.orderBy("block")).alias("outer"))
    return inner.join(outer, "block").select(part, (F.col("inner") + F.col("outer")).cast("long").alias("base"))


def placed(rows: DataFrame, bases: DataFrame, local: Column, name: str, part: str = "part") -> DataFrame:
    """``rows`` with ``name``, the position of each: its part's base and its place ``local`` in the part.

    ``bases`` should be written already.
    """
    return rows.join(broadcast_if(bases, F.lit(1), MOST), part).withColumn(name, F.col("base") + local).drop("base")
