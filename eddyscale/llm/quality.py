"""Quality classifier: random-indexing word vectors pooled per document, then a small network.

Words, parted by white space, are described by two features, their letters and their shape (case,
digits, punctuation), hashed into a fixed number of buckets.  A bucket's index vector is sparse and
ternary, drawn from a fixed seed.  Its context vector is the sum of the index vectors of the
words around its occurrences (random indexing), unit length.  A document's vector is the mean
of both over its words, with a few figures of its form.  A two-layer network in numpy gives a
logit; a temperature fitted on rows set aside in training makes it a probability.

Context vectors need no label and are summed over all documents.  Fitting the network takes a
bounded sample of labelled rows (``most``, by hash of the id) outside the held-out fold.
Scoring reads every whole text in one map.

Scale: no shuffle but of the sample and of 2 MB of context sums for each task, which eight tasks
add up; the model is under 3 MB, whatever the input.

Defined results: null and empty texts get the score of a zero vector; unlabelled rows and null
labels don't train; without training rows every score is 0.5; a null id isn't held out; repeated
rows are scored each, and train as often as their id is labelled; texts are read whole, whatever
their length; a score of exactly the limit is accepted; an empty table gives an empty one.
Columns of any name come back as they were; ``score`` takes an underscore in front where a
column is named so.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, crc_fold, fold, free, pieces, unfold, with_fields
from .words import CLASS, OTHER, UPPER, Hasher, bytes_of, hashes, latin, texts_of

BUCKETS, WIDTH, NEAR = 4096, 64, 2
FORM = 8
#: Bytes that may begin and end a word's core: letters, digits, the underscore and all beyond ASCII.
_INNER = CLASS > 0
_INNER[0x5F] = True
_INNER[0x80:] = True
#: What stands for a run in a shape: one upper-case letter, several, lower-case letters, digits; by class but for the first.
_SIGNS = np.frombuffer(b"XWx9", np.uint8)


def index_vectors(seed: int = 20_240_601, ones: int = 8) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((BUCKETS, WIDTH), np.float32)
    for row in out:
        row[rng.choice(WIDTH, ones, replace=False)] = rng.choice([-1, 1], ones)
    return out / math.sqrt(ones)


def running(marks: np.ndarray) -> np.ndarray:
    """How many marks there are before each place, and in all."""
    out = np.zeros(len(marks) + 1, np.int32)
    np.cumsum(marks, out=out[1:])
    return out


@dataclass
class Described:
    """Of a column: its bytes, where texts and their words begin, and two buckets of each word."""

    data: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray
    letters: np.ndarray
    shapes: np.ndarray


class Describer:
    """Features of whole columns, from hashes of runs of their bytes.

    A word's letters are its core, without what isn't a letter or digit at both ends, lowered; its
    shape has a sign for each run of upper-case letters, lower-case letters and digits, and every
    other byte as it is.  Letters are those of ASCII and Latin-1.
    """

    def __init__(self):
        self.hasher = Hasher()

    def words(self, texts: pa.Array) -> Described:
        data, offsets = bytes_of(texts)
        starts, letters, shapes = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.int32)]
        for at, part, first, end in self.hasher.chunks(data, offsets):
            low, kind = latin(part)
            inside = _INNER[part]
            inner, count = np.flatnonzero(inside), running(inside)
            a, b = count[first], count[end]
            bare = a == b  # nothing but marks: the word itself
            edge = np.append(inner, 0)
            core, stop = np.where(bare, first, edge[np.minimum(a, len(inner))]), np.where(bare, end, edge[np.maximum(b - 1, 0)] + 1)
            letters.append((hashes(low, core, stop) % np.uint64(BUCKETS)).astype(np.int32))
            # a run's first byte gives its sign; a word begins a run
            fresh = np.ones(len(part), bool)
            fresh[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == OTHER)
            fresh[first] = True
            runs = np.flatnonzero(fresh)
            sign = np.where(kind[runs] == OTHER, part[runs], _SIGNS[kind[runs]])
            whole, place = running((part & 0xC0) != 0x80), running(fresh)
            long = whole[np.append(runs[1:], len(part))] - whole[runs] > 1
            sign = np.where((kind[runs] == UPPER) & ~long, _SIGNS[0], sign)
            shapes.append((hashes(sign.astype(np.uint8), place[first], place[end]) % np.uint64(BUCKETS)).astype(np.int32))
            starts.append(first + at)
        found = np.concatenate(starts)
        return Described(data, offsets, np.searchsorted(found, offsets), np.concatenate(letters), np.concatenate(shapes))

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Of each text the share of each bucket, and the form."""
        found = self.words(texts)
        a, b, n = found.letters, found.shapes, len(texts)
        share, form = np.zeros((n, BUCKETS), np.float32), np.zeros((n, FORM), np.float32)
        # running counts of line ends and of characters, which are the bytes that don't continue one
        ends, chars = running(found.data == 10)[found.offsets], running((found.data & 0xC0) != 0x80)[found.offsets]
        lines, size = np.diff(ends) + 1, np.diff(chars)
        for i, (start, stop) in enumerate(zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True)):
            if not (m := stop - start):
                continue
            x, y = a[start:stop], b[start:stop]
            times = np.bincount(x, minlength=BUCKETS)
            share[i] = (times + np.bincount(y, minlength=BUCKETS)) / m
            pairs = np.unique(x[1:].astype(np.int64) * BUCKETS + x[:-1]).size / max(1, m - 1)
            form[i] = (math.log1p(m), np.count_nonzero(times) / m, times.max() / m, float((x[1:] == x[:-1]).mean()) if m > 1 else 0.0, pairs, math.log1p(m / lines[i]), size[i] / m / 10, math.log1p(lines[i]))
        return share, form


def _contexts(fold_at: int = 1 << 27):
    """Each task's sum of neighbours' index vectors by bucket, in whole numbers (times the square root of an index vector's ones)."""

    def run(batches):
        signs, describe = np.sign(index_vectors()).astype(np.float64), Describer()
        # how often one bucket comes just before another; folded into the sums before a count can overflow
        total, pairs, seen = np.zeros((BUCKETS, WIDTH)), np.zeros(BUCKETS * BUCKETS, np.int32), 0

        def fold():
            square = pairs.reshape(BUCKETS, BUCKETS)
            for at in range(0, BUCKETS, 512):
                part = square[at : at + 512].astype(np.float64)
                total[at : at + 512] += part @ signs
                np.add(total, part.T @ signs[at : at + 512], out=total)
            pairs[:] = 0

        for batch in pieces(batches, max_bytes=4 << 20):
            found = describe.words(texts_of(batch))
            doc = np.repeat(np.arange(batch.num_rows), np.diff(found.bounds))
            a, b = found.letters.astype(np.int64), found.shapes.astype(np.int64)
            for at in range(0, len(doc), 1 << 18):
                for d in range(1, NEAR + 1):
                    here = slice(at, min(at + (1 << 18), len(doc) - d))
                    then = slice(at + d, here.stop + d)
                    if here.stop <= at:
                        continue
                    same = doc[here] == doc[then]
                    for x in (a, b):
                        for y in (a, b):
                            np.add.at(pairs, x[here][same] * BUCKETS + y[then][same], np.int32(1))
            seen += len(doc)
            if seen >= fold_at:
                fold()
                seen = 0
        fold()
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(np.int64).tobytes()], pa.binary())], names=["sums"])

    return run


def _added(batches):
    """One sum of a task's sums."""
    total = np.zeros(BUCKETS * WIDTH, np.int64)
    for batch in batches:
        for one in batch.column(0):
            total += np.frombuffer(one.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])


def contexts(docs: DataFrame) -> np.ndarray:
    """Sums of neighbours' index vectors by bucket over all documents; whole numbers, so alike in any order."""
    sums = docs.select("text").mapInArrow(_contexts(), "sums binary").repartition(8).mapInArrow(_added, "sums binary")
    return sum((np.frombuffer(r["sums"], np.int64) for r in sums.collect()), np.zeros(BUCKETS * WIDTH, np.int64)).reshape(BUCKETS, WIDTH)  # 8 of 2 MB


def vectors(contexts: np.ndarray) -> np.ndarray:
    """Index and context vectors side by side."""
    size = np.linalg.norm(contexts, axis=1, keepdims=True)
    return np.hstack([index_vectors(), contexts / np.maximum(size, 1e-9)]).astype(np.float32)


@dataclass
class Network:
    """Two layers over standardised inputs; ``temperature`` divides the logit."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, hidden: int = 24, epochs: int = 60, rate: float = 3e-3, decay: float = 3e-3, seed: int = 7) -> Network | None:
    """Adam on the log loss; a fifth of the rows is set aside for the temperature. None without rows."""
    if not len(y):
        return None
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    aside, own = order[: len(y) // 5], order[len(y) // 5 :]
    mean, scale = x[own].mean(0), x[own].std(0) + 1e-3
    net = Network(mean, scale, rng.normal(0, math.sqrt(2 / x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, math.sqrt(1 / hidden), hidden), 0.0)
    z = (x - mean) / scale
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(epochs):
        rng.shuffle(own)
        for at in range(0, len(own), 128):
            rows = own[at : at + 128]
            h = np.maximum(z[rows] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -40, 40)))
            g = (p - y[rows]) / len(rows)
            back = np.outer(g, params[2]) * (h > 0)
            grads = [z[rows].T @ back + decay * params[0], back.sum(0), h.T @ g + decay * params[2], np.array([g.sum()])]
            step += 1
            for p_, g_, m, v in zip(params, grads, first, second, strict=True):
                m += 0.1 * (g_ - m)
                v += 0.001 * (g_ * g_ - v)
                p_ -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.b2 = float(params[3][0])
    if len(aside):
        logit, truth = net.logits(x[aside]), y[aside]
        loss = lambda t: float(np.mean(np.logaddexp(0, -np.where(truth > 0.5, 1, -1) * logit / t)))
        net.temperature = min(np.geomspace(0.25, 8, 61), key=loss)
    return net


def _vectors_of(texts: pa.Array, describe: Describer, table: np.ndarray) -> np.ndarray:
    share, form = describe(texts)
    return np.hstack([share @ table, form])


def _described(shared):
    def run(batches):
        describe = Describer()
        for batch in pieces(batches, rows=500, max_bytes=4 << 20):
            x = _vectors_of(texts_of(batch), describe, shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("label")), pa.array([r.astype("<f4").tobytes() for r in x], pa.binary())], names=["label", "x"])

    return run


def _scored(shared):
    def run(batches):
        describe, (table, net) = Describer(), shared.value
        for batch in pieces(batches, rows=500, max_bytes=4 << 20):
            n = batch.num_rows
            score = net(_vectors_of(texts_of(batch), describe, table)) if net is not None and n else np.full(n, 0.5)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score.astype(np.float64))], names=[*batch.schema.names, "score"])

    return run


def fit(docs: DataFrame, labels: DataFrame, most: int = 6000, fold: int = 5, column: str = "quality", scratch: Scratch | None = None):
    """(word vectors of all documents, network) from at most ``most`` labelled rows whose crc32 of the id isn't divisible by ``fold``."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "quality")
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull()).where(crc_fold(F.col("doc_id")) % fold != 0)
    rows = rows.select("doc_id", F.col(column).cast("double").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    chosen = scratch.save(docs.select("doc_id", "text").join(F.broadcast(scratch.save(rows, "chosen")), "doc_id").select("text", "label").repartition(8), "sample")
    table = vectors(contexts(docs))
    shared = spark.sparkContext.broadcast(table)
    got = chosen.mapInArrow(_described(shared), "label double, x binary").collect()  # at most ``most`` rows of 0.5 KB
    got = sorted((bytes(r["x"]), r["label"]) for r in got)
    x = np.array([np.frombuffer(b, "<f4") for b, _ in got], np.float64).reshape(len(got), 2 * WIDTH + FORM)
    return table, train(x, np.array([v for _, v in got]))


def _marked(docs: DataFrame, model) -> DataFrame:
    """``kept`` (all columns but the text), text, score."""
    rows = fold(docs, "text")
    return rows.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(model)), with_fields(rows.schema, "score double"))


def score(docs: DataFrame, model) -> DataFrame:
    """All columns of ``docs`` and ``score``, the probability of label 1."""
    return unfold(_marked(docs, model), docs.columns, F.col("score").alias(free("score", docs.columns)))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """Documents whose score is ``least`` at least, all columns kept."""
    return unfold(_marked(docs, fit(docs, labels, **options)).where(F.col("score") >= least), docs.columns)


def report(docs: DataFrame, labels: DataFrame, least: float = 0.3, **options) -> DataFrame:
    """The contract's row of each document."""
    marked = score(docs.select("doc_id", "text"), fit(docs, labels, **options))
    held = F.coalesce(crc_fold(F.col("doc_id")) % 5 == 0, F.lit(False))
    return marked.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
