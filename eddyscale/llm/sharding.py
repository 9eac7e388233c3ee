"""Hilbert-curve sharding, in DataFrame expressions only.

Several metadata dimensions are quantised at equal depth, a cell's place on the Hilbert curve
orders the rows, and runs of that order become shards.  Neighbours on the curve are neighbours
in every dimension, so a shard's minima and maxima of each dimension stay narrow and a reader
prunes shards by any of them.

Numbers are quantised by ``percentile_approx`` over all rows; strings by the whole string: the
distinct values are counted, ranked and cut where their running count passes each share, so that
values with a long common beginning part like any others.

Scale: the texts are read once, to be measured; 40 bytes a row are range-partitioned by curve
index and tie-breakers, so equal cells and copies spread over partitions.  Places in the order
come from each partition's row count, a sum over as many numbers as there are partitions; ranks
of strings likewise, over distinct values.

The law is ``rows``: counts of any two shards differ by one at most.  Defined results: null
text counts as empty; null metadata sorts first; within a cell, rows go by size and checksum, so
that equal texts are neighbours, then by id; a group of equal texts parts only where a shard is
full, or where its other metadata differ; repeated rows are placed each, a null id first; texts
of any length count by their size; fewer rows than shards leave the last shards empty; an empty
table gives an empty one.  Columns of any name are written as they were; the shard's folder takes
an underscore in front where a column is named ``shard``.
"""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import Scratch, free, quoted, unfold


def hilbert_table(dims: int, bits: int) -> list[int]:
    """Curve index of each cell, cells counted with the last dimension fastest (Skilling's transform)."""
    out = []
    for cell in range(1 << (dims * bits)):
        x = [(cell >> (bits * (dims - 1 - d))) & ((1 << bits) - 1) for d in range(dims)]
        q = 1 << (bits - 1)
        while q > 1:
            for i in range(dims):
                if x[i] & q:
                    x[0] ^= q - 1
                else:
                    t = (x[0] ^ x[i]) & (q - 1)
                    x[0] ^= t
                    x[i] ^= t
            q >>= 1
        for i in range(1, dims):
            x[i] ^= x[i - 1]
        t, q = 0, 1 << (bits - 1)
        while q > 1:
            if x[-1] & q:
                t ^= q - 1
            q >>= 1
        x = [v ^ t for v in x]
        out.append(sum(((x[d] >> b) & 1) << (b * dims + dims - 1 - d) for d in range(dims) for b in range(bits)))
    return out


def _levels(column: str, bounds: list):
    """How many of the sorted ``bounds`` a column lies above; null lies above none."""
    level = F.lit(0)
    for bound in sorted(set(bounds)):
        level = level + F.coalesce((F.col(column) > F.lit(bound)).cast("int"), F.lit(0))
    return level


def _string_bounds(rows: DataFrame, columns: list[str], shares: list[float], scratch: Scratch) -> dict[str, list[str]]:
    """Of each string column, the values where the running count of rows passes each share."""
    if not columns:
        return {}
    counts = [rows.where(F.col(c).isNotNull()).groupBy(F.lit(c).alias("dim"), F.col(c).alias("value")).agg(F.count("*").alias("n")) for c in columns]
    counts = reduce(DataFrame.unionByName, counts)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = counts.repartitionByRange(n, "dim", "value").withColumn("part", F.spark_partition_id())
    dealt = scratch.save(dealt, "values")  # written, since partitions hold for one deal only
    sums = dealt.groupBy("dim", "part").agg(F.sum("n").alias("n")).collect()  # one number for each partition
    total, starts = {}, {}
    for r in sorted(sums, key=lambda r: (r["dim"], r["part"])):
        starts[f"{r['dim']}/{r['part']}"] = total.get(r["dim"], 0)
        total[r["dim"]] = total.get(r["dim"], 0) + r["n"]
    if not total:
        return {c: [] for c in columns}
    known = lambda d: F.from_json(F.lit(json.dumps(d)), "map<string,bigint>")
    before = F.element_at(known(starts), F.concat_ws("/", "dim", F.col("part").cast("string")))
    up_to = before + F.sum("n").over(Window.partitionBy("dim", "part").orderBy("value"))
    run = dealt.select("dim", "value", "n", up_to.alias("up_to"), F.element_at(known(total), F.col("dim")).alias("total"))
    marks = F.array(*[F.lit(s) * F.col("total") for s in shares])
    crossed = F.exists(marks, lambda m: (F.col("up_to") >= m) & (F.col("up_to") - F.col("n") < m))
    found = run.where(crossed).select("dim", "value").collect()  # at most one a share
    return {c: [r["value"] for r in found if r["dim"] == c] for c in columns}


def hilbert_order(docs: DataFrame, keep: list[str], dims: list[str], bits: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """``keep`` and ``curve``, the Hilbert index of the quantised ``dims`` (at most 12 bits in all)."""
    if not dims or len(dims) * bits > 12:
        raise ValueError("dims times bits must be from 1 to 12")
    kinds = {f.name: f.dataType for f in docs.schema}
    own = lambda d: F.col(quoted(d)) if isinstance(kinds[d], StringType) else F.col(quoted(d)).cast("long")
    kept = F.struct(*(F.col(quoted(c)).alias(c) for c in keep))
    coded = docs.select(kept.alias("kept"), *(own(d).alias(f"dim{i}") for i, d in enumerate(dims)))
    return unfold(_curve(coded, len(dims), bits, scratch or Scratch(docs.sparkSession, "curve")), keep, F.col("curve").alias(free("curve", keep)))


def _curve(coded: DataFrame, n: int, bits: int, scratch: Scratch) -> DataFrame:
    """Columns but dim0, dim1 and so on, and ``curve``."""
    names = [f"dim{i}" for i in range(n)]
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    strings = [d for d in names if isinstance(coded.schema[d].dataType, StringType)]
    bounds = _string_bounds(coded, strings, shares, scratch)
    if numbers := [d for d in names if d not in strings]:
        found = coded.agg(*(F.percentile_approx(d, shares, 10_000).alias(d) for d in numbers)).first()
        bounds |= {d: found[d] or [] for d in numbers}
    cell = F.lit(0)
    for d in names:
        cell = cell * (1 << bits) + _levels(d, bounds[d])
    table = F.from_json(F.lit(str(hilbert_table(n, bits))), "array<int>")
    return coded.select(*(c for c in coded.columns if c not in names), F.element_at(table, cell + 1).alias("curve"))


def numbered(rows: DataFrame, order: list[str], scratch: Scratch, name: str) -> DataFrame:
    """``rows`` with ``place``, their number from 0 in the order of ``order``, and ``__rows``, how many there are."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *map(F.col, order)).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    # written, since the numbers hold for one deal only
    dealt = scratch.save(dealt.select("*", F.shiftright("__at", 33).cast("int").alias("__part"), F.col("__at").bitwiseAND((1 << 33) - 1).alias("__in")).drop("__at"), name)
    counts = dealt.groupBy("__part").agg(F.count("*").alias("n")).collect()  # one number for each partition
    before, total = {}, 0
    for row in sorted(counts, key=lambda r: r["__part"]):
        before[row["__part"]] = total
        total += row["n"]
    starts = F.from_json(F.lit(str([before.get(k, 0) for k in range(max(before, default=0) + 1)])), "array<bigint>")
    return dealt.select("*", (F.element_at(starts, F.col("__part") + 1) + F.col("__in")).alias("place"), F.lit(total).cast("long").alias("__rows")).drop("__part", "__in")


def runs(rows: DataFrame, shards: int) -> DataFrame:
    """``shard`` and ``slot`` from ``place``: equal runs, the first ones longer by one row."""
    q, r = F.floor(F.col("__rows") / shards).cast("long"), F.col("__rows") % shards
    wide = r * (q + 1)
    first = F.col("place") < wide
    rest = F.col("place") - wide
    safe = F.greatest(q, F.lit(1))
    shard = F.when(first, F.floor(F.col("place") / (q + 1))).otherwise(r + F.floor(rest / safe))
    slot = F.when(first, F.col("place") % (q + 1)).otherwise(rest % safe)
    return rows.select("*", shard.cast("int").alias("shard"), slot.cast("long").alias("slot")).drop("place", "__rows")


def shard_documents(docs: DataFrame, shards: int = 24, bits: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, size, text_crc32, curve, shard, slot of each row."""
    scratch = scratch or Scratch(docs.sparkSession, "sharding")
    known = {f.name for f in docs.schema}
    text = lambda c: F.col(c).cast("string") if c in known else F.lit(None).cast("string")
    measured = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_measures(), text("source").alias("dim0"), text("lang").alias("dim1")).withColumn("dim2", F.col("size"))
    curve = _curve(scratch.save(measured, "measured"), 3, bits, scratch)
    return runs(numbered(curve, ["curve", "size", "text_crc32", "doc_id"], scratch, "ordered"), shards)


def _measures():
    return (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")


def write_shards(docs: DataFrame, path: str, shards: int = 24, bits: int = 4) -> None:
    """The documents as one folder a shard, for readers that prune by minima and maxima.

    Rows alike in id, size and checksum go where the first of them goes.
    """
    key = ["doc_id", "size", "text_crc32"]
    place = shard_documents(docs, shards, bits).groupBy(*key).agg(F.min("shard").alias("shard"), F.min("curve").alias("curve"))
    place = place.withColumnsRenamed({c: f"_{c}" for c in key})
    rows = docs.select(F.struct(*(F.col(quoted(c)).alias(c) for c in docs.columns)).alias("kept"), F.col("doc_id").cast("long").alias("doc_id"), *_measures())
    on = F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("size") == F.col("_size")) & (F.col("text_crc32") == F.col("_text_crc32"))
    folder = free("shard", docs.columns)
    out = rows.join(place, on).repartitionByRange("shard", "curve").sortWithinPartitions("shard", "curve")
    unfold(out, docs.columns, F.col("shard").alias(folder)).write.partitionBy(folder).parquet(path)


def report(docs: DataFrame, shards: int = 24) -> DataFrame:
    """The contract's row of each document."""
    out = shard_documents(docs, shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")
