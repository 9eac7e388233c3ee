"""Importance resampling of documents towards a target distribution of hashed word runs.

Features are all runs of one to ``WIDTH`` consecutive words; each falls into a bucket by its
checksum.  A bucket's gain is the logarithm of its share among the target's features over its share
among the documents'; a document's weight is the sum of its features' gains.  Documents are drawn
without replacement by the largest weight plus Gumbel noise, which a hash of the id gives.

Long texts: a text beyond ``CHUNK`` bytes is split between words into chunks that carry the next
WIDTH - 1 words along.  A chunk owns the runs that start in front of its carry, so each run counts
once; chunks are written in small row groups, which other tasks take up, and their counts and
weights are summed by document.

Checksums: crc32 is linear, so a run's is that of its parts, shifted by the length of what follows;
whole columns of words are done at once.

Scale: two maps over the texts, one that counts buckets (a row a bucket and task) and one that
weighs; no text is shuffled.  Gains are one number a bucket.  Ranks come from a range shuffle of
narrow rows, ordered by score, id and a row number, so that ties and repeated ids part as well, and
from sums of partitions' rows (``offsets``); no window spans all rows.

Defined results: null and empty texts have no words, no features and weight 0, and aren't drawn; of
equal scores the smaller id goes first, a null one before all, then the row read first; a null id is
hashed as an empty one; repeated rows count each; an empty target gives every bucket a share alike;
an empty table gives no rows.  Kept columns of any name come back as they were; a result's column
takes an underscore in front where a kept one is named so.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import offsets
from .common import Scratch, free, pieces, quoted, unfold, with_fields
from .words import LOWERED, Hasher, texts_of

WIDTH, BUCKETS, CHUNK = 3, 10_000, 1 << 16
#: Of each byte: whether it ends a word.  Words are digits, letters and all bytes beyond ASCII.
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


# --- checksums ----------------------------------------------------------------------------------


def _byte_table() -> np.ndarray:
    """The checksum's register after one byte, by the register's lowest byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> np.uint32(1)) ^ np.uint32(0xEDB88320), c >> np.uint32(1)).astype(np.uint32)
    return c


_BYTE = _byte_table()
#: Lengths up to which a shift is one look-up a byte of the register; what is longer goes on by doubling.
_NEAR = 64


def _shift_tables() -> tuple[np.ndarray, list[np.ndarray]]:
    """What each byte of a register becomes after 0 to 63 zero bytes, and after 64, 128, 256.. of them."""
    one = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * j) for j in range(4)])
    near = []
    for _ in range(_NEAR):
        near.append(one)
        one = _BYTE[one & 255] ^ (one >> np.uint32(8))
    far = [one.ravel()]
    for _ in range(25):
        far.append(_applied(far[-1], 0, far[-1]))
    return np.stack(near).ravel(), far


def _applied(table: np.ndarray, base, c: np.ndarray) -> np.ndarray:
    out = table[base + (c & 255)]
    for j in (1, 2, 3):
        out = out ^ table[base + 256 * j + ((c >> np.uint32(8 * j)) & 255)]
    return out


_SHIFTS, _DOUBLED = _shift_tables()


def shifted(c: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Registers after ``length`` zero bytes: crc(ab) is crc(a) shifted by b's length, xor crc(b)."""
    out, rest, bit = _applied(_SHIFTS, (length % _NEAR).astype(np.int64) << 10, c), length // _NEAR, 0
    while rest.any():
        own = np.flatnonzero((rest >> bit) & 1)
        out[own] = _applied(_DOUBLED[bit], 0, out[own])
        rest = np.where((rest >> bit) & 1, rest ^ (1 << bit), rest)
        bit += 1
    return out


def checksums(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """crc32 of the runs of bytes from ``first`` to ``end``."""
    size = end - first
    c, own, k = np.full(len(first), 0xFFFFFFFF, np.uint32), np.flatnonzero((size > 0) & (size <= _NEAR)), 0
    while len(own):
        register = c[own]
        c[own] = _BYTE[(register ^ data[first[own] + k]) & 255] ^ (register >> np.uint32(8))
        k += 1
        own = own[size[own] > k]
    c = ~c
    whole = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > _NEAR).tolist():
        c[i] = zlib.crc32(whole[first[i] : end[i]])
    return c


_SPACE = np.uint32(zlib.crc32(b" "))


class Runs:
    """Of a column of texts: the buckets of runs of each width, the texts' first words, and which words start a run that counts."""

    def __init__(self, texts: pa.Array, owned: np.ndarray | None, width: int, buckets: int):
        words = _WORDS(texts)
        low = LOWERED[words.data]
        c, size = checksums(low, words.starts, words.ends), words.ends - words.starts
        del low
        n, self.bounds = len(c), words.bounds
        row = np.repeat(np.arange(len(texts)), np.diff(self.bounds))
        last = self.bounds[1:][row]
        self.counts = np.ones(n, bool) if owned is None else words.starts - words.offsets[:-1][row] < owned[row]
        with_space = shifted(np.full(n, _SPACE), size) ^ c
        self.buckets, self.valid = [], []
        for k in range(width):
            if k:
                c = shifted(c[: n - k], size[k:] + 1) ^ with_space[k:] if n > k else c[:0]
            self.valid.append(self.counts[: len(c)] & (np.arange(len(c)) + k < last[: len(c)]))
            self.buckets.append((c % np.uint32(buckets)).astype(np.int64))

    def times(self, buckets: int) -> np.ndarray:
        return sum(np.bincount(b[v], minlength=buckets) for b, v in zip(self.buckets, self.valid, strict=True))

    def sums(self, gains: np.ndarray | None = None) -> np.ndarray:
        """Of each text the number of its runs, or the sum of their gains."""
        total = np.zeros(len(self.counts) + 1, np.int64)
        for b, v in zip(self.buckets, self.valid, strict=True):
            total[1 : len(b) + 1] += v if gains is None else np.where(v, gains[b], 0)
        total = np.cumsum(total)
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def words(self) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(self.counts)))
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


_WORDS = Hasher(blank=APART)


# --- long texts ---------------------------------------------------------------------------------


def _next(data: np.ndarray, at: int, solid: bool) -> int:
    """The first byte from ``at`` on that is in a word, or isn't; the end if there is none."""
    while at < len(data):
        if len(found := np.flatnonzero(APART[data[at : at + 4096]] != solid)):
            return at + int(found[0])
        at += 4096
    return len(data)


def chunks(data: np.ndarray, size: int, carry: int):
    """(start, end of what it owns, end) of a text's chunks; each starts and ends between words, and ``carry`` words follow what it owns."""
    start = 0
    while start < len(data):
        cut = start + size
        if cut < len(data):
            cut = _next(data, _next(data, cut, False) if not APART[data[cut - 1]] else cut, True)
        cut = end = min(cut, len(data))
        for _ in range(carry):
            end = _next(data, _next(data, end, True), False)
        yield start, cut, end
        start = cut


def _split(size: int, carry: int):
    def run(batches):
        for batch in pieces(batches):
            take, texts, owns, held = [], [], [], 0

            def made():
                own = [batch.column(batch.schema.get_field_index(n)).take(pa.array(take, pa.int64())) for n in ("kept", "rid")]
                return pa.RecordBatch.from_arrays([*own, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(owns, pa.int64())], names=["kept", "rid", "text", "owned"])

            column = texts_of(batch)
            for i in range(batch.num_rows):
                data = np.frombuffer(column[i].as_buffer(), np.uint8)
                for start, cut, end in chunks(data, size, carry):
                    take.append(i)
                    texts.append(data[start:end].tobytes())
                    owns.append(cut - start)
                    held += end - start
                    if held > 8 << 20:
                        yield made()
                        take, texts, owns, held = [], [], [], 0
            if take:
                yield made()

    return run


def split(rows: DataFrame, size: int, width: int, scratch: Scratch, name: str) -> tuple[DataFrame, DataFrame]:
    """(kept, text) of short texts, and written chunks (kept, rid, text, owned) of long ones."""
    long = F.octet_length("text") > size
    numbered = rows.where(long).withColumn("rid", F.monotonically_increasing_id())
    made = numbered.mapInArrow(_split(size, width - 1), with_fields(rows.select("kept").schema, "rid long, text string, owned long"))
    # one task's chunks of a long text are row groups that many tasks read
    return rows.where(F.coalesce(~long, F.lit(True))), scratch.save(made, name, {"parquet.block.size": 4 << 20})


# --- counts, gains and weights ------------------------------------------------------------------


def _counted(width: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in pieces(batches, max_bytes=4 << 20):
            total += Runs(texts_of(batch), _owned(batch), width, buckets).times(buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    return run


def _owned(batch: pa.RecordBatch) -> np.ndarray | None:
    at = batch.schema.get_field_index("owned")
    return None if at < 0 else batch.column(at).to_numpy(zero_copy_only=False)


def counts(parts: tuple[DataFrame, DataFrame], width: int = WIDTH, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, of short texts and chunks."""
    short, long = parts
    made = short.select("text").mapInArrow(_counted(width, buckets), "bucket int, n long").unionByName(long.select("text", "owned").mapInArrow(_counted(width, buckets), "bucket int, n long"))
    out = np.zeros(buckets, np.int64)
    for r in made.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most a row a bucket
        out[r["bucket"]] = r["n"]
    return out


def gains(documents: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of each bucket's shares, one feature added to every bucket, rounded down."""
    n, s, t = len(documents), float(documents.sum()), float(target.sum())
    ratio = (target + 1.0) * (s + n) / ((documents + 1.0) * (t + n))
    return np.array([math.floor(1000 * math.log(r)) for r in ratio.tolist()], np.int64)


def _weighed(shared, width: int):
    def run(batches):
        for batch in pieces(batches, max_bytes=4 << 20):
            table = shared.value
            runs = Runs(texts_of(batch), _owned(batch), width, len(table))
            own = [batch.column(i) for i, n in enumerate(batch.schema.names) if n in ("kept", "rid")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(x) for x in (runs.words(), runs.sums(), runs.sums(table)))], names=[*[n for n in batch.schema.names if n in ("kept", "rid")], "n_words", "n_features", "weight"])

    return run


def weights(parts: tuple[DataFrame, DataFrame], table: np.ndarray, width: int = WIDTH) -> DataFrame:
    """(kept, n_words, n_features, weight) of each document."""
    short, long = parts
    shared, made = short.sparkSession.sparkContext.broadcast(table), "n_words long, n_features long, weight long"
    one = short.mapInArrow(_weighed(shared, width), with_fields(short.select("kept").schema, made))
    many = long.mapInArrow(_weighed(shared, width), with_fields(long.select("kept", "rid").schema, made))
    many = many.groupBy("rid").agg(F.first("kept").alias("kept"), *(F.sum(n).alias(n) for n in ("n_words", "n_features", "weight"))).drop("rid")
    return one.unionByName(many)


def noise(key: Column, seed: int) -> Column:
    """Thousandths of Gumbel noise from a hash of the seed and the id, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, drawn: int, scratch: Scratch) -> DataFrame:
    """``scored`` (score, key, ..) with rank from 1 by falling score, then by key; null beyond ``drawn``."""
    order = [F.desc("score"), F.asc_nulls_first("key"), F.asc("row")]
    # the number that a row has here tells its partition and its place there
    laid = scratch.save(scored.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), "laid")
    laid = laid.withColumn("part", F.shiftright("at", 33)).withColumn("local", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    bases = scratch.save(offsets.before(laid.groupBy("part").agg(F.count("*").alias("total"))), "bases")
    placed = offsets.placed(laid, bases, F.col("local"), "place")
    return placed.select(*scored.columns, F.when(F.col("place") < drawn, F.col("place") + 1).cast("long").alias("rank"))


def draw(docs: DataFrame, target: DataFrame, percent: int = 5, least: int = 20, seed: int = 42, width: int = WIDTH, buckets: int = BUCKETS, chunk: int = CHUNK, key: str = "doc_id", keep: tuple[str, ...] = ("doc_id",), scratch: Scratch | None = None) -> DataFrame:
    """``keep`` columns, n_words, n_features, weight, score and rank of every document; a rank is that of a drawn one.

    Drawn are ``percent`` of the documents of ``least`` words, rounded down.
    """
    scratch = scratch or Scratch(docs.sparkSession, "resampling")
    fields = [F.col(quoted(c)).alias(c) for c in keep]
    rows = docs.select(F.struct(F.col(quoted(key)).alias("key"), F.struct(*(fields or [F.lit(0).alias("none")])).alias("own")).alias("kept"), "text")
    aim = target.select(F.struct(F.lit(0).alias("none")).alias("kept"), "text")
    parts, aims = split(rows, chunk, width, scratch, "chunks"), split(aim, chunk, width, scratch, "target")
    table = gains(counts(parts, width, buckets), counts(aims, width, buckets))
    made = weights(parts, table, width).select(F.col("kept.key").alias("key"), F.col("kept.own").alias("kept"), "n_words", "n_features", "weight")
    made = made.withColumn("score", F.col("weight") + noise(F.col("key"), seed)).withColumn("row", F.monotonically_increasing_id())
    scored = scratch.save(made, "scored")
    many = F.col("n_words") >= least
    drawn = percent * scored.where(many).count() // 100
    every = ranked(scored.where(many), drawn, scratch).unionByName(scored.where(~many).withColumn("rank", F.lit(None).cast("long")))
    return unfold(every, list(keep), *(F.col(n).alias(free(n, list(keep))) for n in ("n_words", "n_features", "weight", "score", "rank")))


def resample(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The drawn documents, with all their columns."""
    names = tuple(docs.columns)
    rank = free("rank", list(names))
    return draw(docs, target, keep=names, **options).where(F.col(quoted(rank)).isNotNull()).select(*map(quoted, names))


def report(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """The contract's row of each document."""
    return draw(docs.select("doc_id", "text"), target, **options).select("doc_id", "n_features", "weight", "score", "rank")
