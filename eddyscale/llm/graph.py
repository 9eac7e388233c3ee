"""Connected components of an edge table by alternating large and small stars.

Every round moves each node's neighbours to the smallest of them.  Rounds are written to the
shared folder; nothing of the graph reaches the driver but a count and a checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def _both(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m"))


def components(edges: DataFrame, scratch: Scratch, name: str = "graph") -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b); component is its smallest node."""
    old, seen, k = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0"), None, 0
    while True:
        k += 1
        both = _both(old)
        # large star: larger neighbours go to the least of the neighbourhood; written first, so that
        # both sides of the join are shuffled for it and a node with very many neighbours is split
        least = scratch.save(_least(both).withColumnRenamed("n", "a"), f"{name}-least-{k}")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours, and the node itself
        down = large.where("a > b")
        least = _least(down).withColumnRenamed("n", "a")
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
        new = scratch.save(small.where("a <> b").distinct(), f"{name}-{k}")
        now = tuple(new.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
        scratch.drop(f"{name}-{k - 1}", f"{name}-least-{k}")
        if now == seen:
            break
        old, seen = new, now
    roots = new.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return new.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
