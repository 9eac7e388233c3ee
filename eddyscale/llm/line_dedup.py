"""Line dedup over levelled sorted runs of line hashes.

Documents come in batches of ascending ids.  A batch's line hashes are merge-anti-joined with
the runs of the batches before it: hashes found there are known, the others are new and make a
sorted run of level 0.  As soon as a level holds ``fanout`` runs they are merged into one run of
the next level, so that the number of runs grows with the logarithm of the number of batches.

A run is a table bucketed by hash, one sorted file a bucket.  A probe shuffles and sorts the
batch's hashes once and merges them with each run where it lies; runs are merged bucket by
bucket.  Neither shuffles nor sorts a run again.

A line that is known, or new but held by a smaller document of its own batch, goes.  Since
batches ascend, the smallest document holding a line keeps it.

Scale: texts are read by two maps; between them go only 128-bit hashes, 24 bytes for each
distinct line of a document, written in a folder for each batch: a batch reads its own, once for
its keys and once for what it loses, whatever the number of batches.  Where the input's splits
hold ids of many batches each, hashes are dealt out by batch first, in equal shares.  A batch holds at most ``per_core`` bytes of text for each core, so
that a larger cluster takes larger and fewer ones; there are ``least_batches`` at least.  Hashes
are grouped with map-side combining, and the join of (hash, document) pairs with the duplicated
hashes is a plain one, whose hot keys adaptive execution splits.  Dropped hashes are gathered
per document, never per line.

Defined results: a null or empty text is one empty line; repeated rows of an id are one
document, so that a line they share stays in each; a row of null id owns no line and loses those
that any document with an id holds; very long texts are whole, line by line; ties can't occur,
since the smallest id is one; an empty table gives an empty one.  Columns of any name come back
as they were; the counts ``n_lines`` and ``n_dropped`` take an underscore in front where a column
is named so already.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, Scratch, ascii_lower, column_list, fold, free, pieces, unfold, with_fields

HASHES = ["h1", "h2"]


def line_key(line: str) -> str:
    return ascii_lower(line.strip(BLANKS))


def _hash(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode("utf-8", "surrogatepass"))


def _halves(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _pairs(least: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in pieces(batches):
            ids, first, second = [], [], []
            for doc, text in zip(column_list(batch, "doc_id"), column_list(batch, "text"), strict=True):
                keys = {k for line in (text or "").split("\n") if len(s := line.strip(BLANKS)) >= least for k in (ascii_lower(s),)}
                for k in keys:
                    a, b = _halves(_hash(k))
                    ids.append(doc)
                    first.append(a)
                    second.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, first, second)], names=["doc_id", *HASHES])

    return run


@contextlib.contextmanager
def _merging(spark: SparkSession):
    """Plans made within take a bucket's only file as sorted, and merge."""
    wanted = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.join.preferSortMergeJoin": "true"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class LevelledRuns:
    """Sorted runs of distinct hashes, merged level by level."""

    def __init__(self, scratch: Scratch, fanout: int = 2):
        self.scratch, self.spark, self.fanout, self.made = scratch, scratch.spark, fanout, 0
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str | None, DataFrame]]] = []

    def write(self, hashes: DataFrame, name: str) -> DataFrame:
        """A bucketed table, a bucket's rows sorted by hash.  ``hashes`` are partitioned by them."""
        entry = f"run_{uuid.uuid4().hex}"
        with _merging(self.spark):
            hashes.write.bucketBy(self.buckets, *HASHES).sortBy(*HASHES).option("path", f"{self.scratch.root}/{name}").saveAsTable(entry)
            table = self.spark.table(entry)
        self.spark.sql(f"DROP TABLE {entry}")  # the entry only: the files stay, and the frame has found them
        return table

    def add(self, name: str | None, run: DataFrame) -> None:
        """``run``: bucketed and sorted, of hashes that are in no run yet; ``name``: its folder, if it goes when it has been merged."""
        new = (name, run)
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(new)
            if len(self.levels[level]) < self.fanout:
                return
            old, self.levels[level] = self.levels[level], []
            new = old[0]
            for other in old[1:]:
                self.made += 1
                name = f"merged-{self.made}"
                merged = (name, self.write(self.merged(new[1], other[1]), name))
                self.scratch.drop(*(n for n in (new[0], other[0]) if n))
                new = merged

    @staticmethod
    def merged(one: DataFrame, other: DataFrame) -> DataFrame:
        """All hashes of two disjoint runs, merged bucket by bucket."""
        return one.select(*HASHES).join(other.select(*HASHES).hint("merge"), HASHES, "full_outer")

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for _, run in level]

    def split(self, hashes: DataFrame) -> DataFrame:
        """``hashes`` with ``known``: whether a run holds the hash."""
        marks = []
        for i, run in enumerate(self.runs()):
            hashes = hashes.join(run.select(*HASHES, F.lit(True).alias(f"__in{i}")).hint("merge"), HASHES, "left")
            marks.append(F.col(f"__in{i}"))
        known = F.coalesce(*marks, F.lit(False)) if marks else F.lit(False)
        return hashes.withColumn("known", known).drop(*(f"__in{i}" for i in range(len(marks))))


def batches_for(docs: DataFrame, per_core: int = 256 << 20, least_batches: int = 4) -> int:
    """As many batches as keep each at ``per_core`` bytes of text a core."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(least_batches, -(-size // (per_core * docs.sparkSession.sparkContext.defaultParallelism)))


def in_order(docs: DataFrame, bounds: list[int], most: float = 4.0) -> bool:
    """Whether the input's splits hold ids of few batches each, so that each may write a file for every batch it has."""
    of = lambda c: sum((F.col(c) > b).cast("int") for b in bounds) if bounds else F.lit(0)
    ends = docs.where("doc_id is not null").groupBy(F.spark_partition_id()).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    files = ends.agg(F.avg(of("high") - of("low") + 1).alias("n")).first()["n"]
    return files is None or files <= most


def dealt(pairs: DataFrame, batches: int) -> DataFrame:
    """Hashes by batch, each batch's in equal shares, whatever hash or document they are of."""
    spark = pairs.sparkSession
    shares = max(-(-int(spark.conf.get("spark.sql.shuffle.partitions")) // batches), spark.sparkContext.defaultParallelism)
    return pairs.repartition(batches * shares, "batch", F.pmod(F.xxhash64("doc_id", *HASHES), F.lit(shares)))


def dropped_hashes(docs: DataFrame, least: int = 10, batches: int | None = None, fanout: int = 2, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, drops): of each document that loses lines, the hashes of those lines."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "line-dedup")
    batches = batches or batches_for(docs)
    schema = "doc_id long, h1 long, h2 long"
    cuts = docs.where("doc_id is not null").stat.approxQuantile(["doc_id"], [k / batches for k in range(1, batches)], 0.1 / batches)[0] if batches > 1 else []
    bounds = sorted({int(x) for x in cuts})
    step = sum((F.col("doc_id") > b).cast("int") for b in bounds) if bounds else F.lit(0)
    pairs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pairs(least), schema)
    # null ids come last
    pairs = pairs.withColumn("batch", F.coalesce(step, F.lit(len(bounds))).cast("int"))
    lines = scratch.save(pairs if in_order(docs, bounds) else dealt(pairs, len(bounds) + 1), "lines", by="batch")
    runs, gone = LevelledRuns(scratch, fanout), []
    for k in range(len(bounds) + 1):
        here = lines.where(F.col("batch") == k)
        keys = here.groupBy(*HASHES).agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last"), F.max(F.col("doc_id").isNull()).alias("loose"))
        with _merging(spark):
            keys = runs.write(runs.split(keys), f"keys-{k}")
        # the same files, not as a bucketed table: a join with them can split hot hashes
        plain = spark.read.schema(keys.schema).parquet(f"{scratch.root}/keys-{k}")
        shared = plain.where("known or owner < last or (loose and owner is not null)").select(*HASHES, F.when(~F.col("known"), F.col("owner")).alias("owner"), "known")
        if k < len(bounds):
            runs.add(None, keys.where(~F.col("known")).select(*HASHES))
        hit = here.join(shared, HASHES).where("known or doc_id is null or doc_id > owner")
        gone.append(hit.select("doc_id", *HASHES))
    whole = gone[0]
    for part in gone[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy("doc_id").agg(F.collect_set(F.struct(*HASHES)).alias("drops"))


def _keep(least: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in pieces(batches):
            texts, counts, losses = [], [], []
            for text, drops in zip(column_list(batch, "text"), column_list(batch, "drops"), strict=True):
                lines = (text or "").split("\n")
                counts.append(len(lines))
                if drops:
                    known = {(d["h1"], d["h2"]) for d in drops}
                    lines = [x for x in lines if len(s := x.strip(BLANKS)) < least or _halves(_hash(ascii_lower(s))) not in known]
                losses.append(counts[-1] - len(lines))
                texts.append(text if text is None and not drops else "\n".join(lines))
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("kept")), pa.array(texts, pa.string()), pa.array(counts, pa.int64()), pa.array(losses, pa.int64())], names=["kept", "text", "n_lines", "n_dropped"])

    return run


def _deduplicated(docs: DataFrame, least: int, **options) -> DataFrame:
    """``kept`` (all columns but the text), text, n_lines, n_dropped."""
    drops = dropped_hashes(docs.select("doc_id", "text"), least, **options)
    rows = fold(docs, "text").withColumn("doc", F.col("kept.doc_id").cast("long"))
    joined = rows.join(drops, F.col("doc").eqNullSafe(F.col("doc_id")), "left").select("kept", "text", "drops")
    return joined.mapInArrow(_keep(least), with_fields(rows.select("kept").schema, "text string, n_lines long, n_dropped long"))


def dedup_lines(docs: DataFrame, least: int = 10, **options) -> DataFrame:
    """All columns of ``docs``, text without lines that an earlier document holds, n_lines, n_dropped."""
    done = _deduplicated(docs, least, **options)
    return unfold(done, docs.columns, *(F.col(n).alias(free(n, docs.columns)) for n in ("n_lines", "n_dropped")))


def without_known_lines(docs: DataFrame, least: int = 10, **options) -> DataFrame:
    """Exactly the columns of ``docs``; ``n_chars``, if there is one, follows a text that lost lines."""
    done = _deduplicated(docs, least, **options)
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        done = done.withColumn("kept", F.when(F.col("n_dropped") > 0, F.col("kept").withField("n_chars", size)).otherwise(F.col("kept")))
    return unfold(done, docs.columns)


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's row of each document."""
    kept = dedup_lines(docs.select("doc_id", "text"), **options)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
