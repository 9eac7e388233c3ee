"""Approximate nearest neighbours by randomly rotated one-bit codes.

Vectors are scaled to unit length and dealt to the nearest of several centres.  What is left of
a vector after its centre is turned by several random rotations, and the signs of all turned
coordinates are its code, packed to bits.  With correction scalars (how long the rest is, how
well the code points along it, how far the code's image lies off it), a query's inner product
with a vector is estimated from the code alone, with an error bound.

A search has four steps:

1. every query is estimated against every code, and the few best guesses are kept;
2. those are scored on the original vectors: the k-th best score is what others must reach;
3. every query is estimated against every code again, and codes whose upper bound reaches that
   score are the survivors;
4. the survivors' original vectors are fetched, and scored in double precision.

The bound allows for ``sure`` standard deviations of the estimate; ``sure=None`` takes the bound
that no vector can pass (Cauchy and Schwarz), and the result is exact.

Centres are fitted on a bounded sample (``most`` rows, by hash of the id); every row is indexed.

Scale: equal vectors are one code with their smallest ids, so a vector that a third of all rows
share is one candidate.  A code takes 84 bytes for a vector of 64 dimensions, the vector 256 or 512;
codes and queries meet in groups of bounded size, by hash, each pair of groups one unit of work,
and original vectors move for survivors only, of which a query has about as many in a large
table as in a small one.  Nothing is sent to all tasks but centres and rotations, and what is
broadcast is counted first.  The scan itself is of every query against every code, as asked for.

Defined results: vectors that are null, empty, zero, of another length than most, or hold null
or non-finite components take no part; a null id takes no part; rows of one id are one
candidate, with its best score, and one query, of its least vector; ties go to the smaller id;
fewer candidates than k give all; an empty table gives no rows; other columns, whatever their
names, aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType

from .common import Scratch, broadcast_if

#: Codes and queries of one unit of work, about.
CODES, QUERIES = 65_536, 8_192
#: Codes and queries of one matrix product.
_TILE, _ROWS = 8_192, 256


def _valid(column: str):
    e = F.col(column)
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return e.isNotNull() & (F.size(e) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(e, lambda x: x != 0)


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # no overflow of squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def centres(x: np.ndarray, k: int, rounds: int = 10, seed: int = 5) -> np.ndarray:
    """Means of k clusters; shorter than one, so that what is left of unit vectors is no longer than they are."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = nearest_centre(x, c)
        total, n = np.zeros_like(c), np.bincount(own, minlength=len(c))
        np.add.at(total, own, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmax(2 * (x @ c.T) - (c * c).sum(1), axis=1)


def rotations(dim: int, n: int, seed: int = 11) -> np.ndarray:
    """``n`` random rotations side by side, scaled so that they keep lengths."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(dim, dim))) for _ in range(n)]
    return np.hstack([q * np.sign(np.diag(r)) for q, r in turns]) / math.sqrt(n)


def encode(x: np.ndarray, own: np.ndarray, c: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of unit vectors: packed signs, and scale, spread and bias of the estimate.

    With r = x - c, u its direction, z the unit vector of the signs and p its image in the space of
    x, <q - c, r> is guessed as |r| <q - c, p> / <u, p>.  The guess errs by |r| / <u, p> times the
    inner product of q - c with the part of p that is off u.  All that doesn't depend on q is the
    bias: <q, x> = <q, c> + <q - c, r> + <c, r>.
    """
    rest = x - c[own]
    length = np.linalg.norm(rest, axis=1)
    u = rest / np.maximum(length, 1e-300)[:, None]
    signs = u @ turn > 0
    z = np.where(signs, 1.0, -1.0) / math.sqrt(turn.shape[1])
    image = z @ turn.T
    inner = np.maximum((image * u).sum(1), 1e-9)
    off = np.linalg.norm(image - inner[:, None] * u, axis=1)
    scale = np.where(length > 1e-12, length / inner, 0.0)
    return np.packbits(signs, axis=1), scale, scale * off, scale * (image * c[own]).sum(1) - (c[own] * rest).sum(1)


def _rows(batch, dim: int):
    return unit(_matrix(batch.column(batch.schema.get_field_index("embedding")), dim))


def _coded(shared, dim: int):
    """(key, centre, bits, scale, spread, bias) of each distinct vector."""

    def run(batches):
        c, turn = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _rows(batch, dim)
            own = nearest_centre(x, c)
            bits, *scalars = encode(x, own, c, turn)
            columns = [batch.column(batch.schema.get_field_index("key")), pa.array(own.astype(np.int32)), pa.array([b.tobytes() for b in bits], pa.binary()), *(pa.array(v.astype(np.float32)) for v in scalars)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "centre", "bits", "scale", "spread", "bias"])

    return run


def _scan(shared, dim: int, sure: float | None, keep: int | None):
    """Of a group of codes and one of queries: the ``keep`` best guesses of each query, or all whose bound reaches its floor."""

    def run(codes: pa.Table, queries: pa.Table) -> pa.Table:
        c, turn = shared.value
        root = math.sqrt(turn.shape[1])
        out: list[tuple[np.ndarray, ...]] = []
        if codes.num_rows and queries.num_rows:
            key = codes.column("key").to_numpy()
            own = codes.column("centre").to_numpy()
            packed = np.frombuffer(b"".join(codes.column("bits").to_pylist()), np.uint8).reshape(len(key), -1)
            scale, spread, bias = (codes.column(n).to_numpy() for n in ("scale", "spread", "bias"))
            wide = np.float32(1 if sure is None or dim < 2 else min(1, sure / math.sqrt(dim - 1)))
            qids, u, floors = queries.column("query_id").to_numpy(), unit(_matrix(queries.column("embedding"), dim)), queries.column("floor").to_numpy()
            turned, near = (u @ turn / root).astype(np.float32), (u @ c.T).astype(np.float32)
            apart = np.sqrt(np.maximum(1 + (c * c).sum(1) - 2 * (u @ c.T), 0)).astype(np.float32)
            best: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(0, len(qids), _ROWS)]
            for at in range(0, len(key), _TILE):
                tile = slice(at, at + _TILE)
                signs = np.unpackbits(packed[tile], axis=1, count=turn.shape[1]).astype(np.float32) * 2 - 1
                mine, width = own[tile], wide * spread[tile]
                for block, start in enumerate(range(0, len(qids), _ROWS)):
                    some = slice(start, start + _ROWS)
                    guess = near[some][:, mine] + (turned[some] @ signs.T) * scale[tile] - bias[tile]
                    if keep is None:
                        bound = guess + apart[some][:, mine] * width
                        a, b = np.nonzero(bound >= (floors[some][:, None] - 1e-5))
                        out.append((qids[some][a], key[tile][b], guess[a, b]))
                    else:
                        n = min(keep, guess.shape[1])
                        top = np.argpartition(-guess, n - 1, axis=1)[:, :n]
                        best[block].append((key[tile][top], np.take_along_axis(guess, top, 1)))
            for block, start in enumerate(range(0, len(qids), _ROWS)):
                if best[block]:
                    keys, guess = (np.concatenate(p, axis=1) for p in zip(*best[block], strict=True))
                    n = min(keep, guess.shape[1])
                    top = np.argpartition(-guess, n - 1, axis=1)[:, :n]
                    out.append((np.repeat(qids[start : start + _ROWS], n), np.take_along_axis(keys, top, 1).ravel(), np.take_along_axis(guess, top, 1).ravel()))
        kinds = (np.int64, np.int64, np.float32)
        columns = [np.concatenate([o[i] for o in out]).astype(t) if out else np.zeros(0, t) for i, t in enumerate(kinds)]
        return pa.table({"query_id": columns[0], "key": columns[1], "guess": columns[2].astype(np.float64)})

    return run


def exact(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of rows, summed in order of the components, so that any engine gets the same bits."""
    total = lambda a: np.cumsum(a, axis=1)[:, -1]
    return total(x * y) / (np.sqrt(total(y * y)) * np.sqrt(total(x * x)))


def _scored(dim: int):
    """(query_id, vec_id, score) of every id of each pair's vector but the query's own."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 20_000):
                part = batch.slice(at, 20_000)
                score = exact(_matrix(part.column("vector"), dim), _matrix(part.column("query"), dim))
                ids = part.column("ids")
                n = np.diff(ids.offsets.to_numpy())
                flat, qid = ids.flatten().to_numpy(), np.repeat(part.column("query_id").to_numpy(), n)
                other = flat != qid
                yield pa.RecordBatch.from_arrays([pa.array(qid[other]), pa.array(flat[other]), pa.array(np.repeat(score, n)[other])], names=["query_id", "vec_id", "score"])

    return run


class Index:
    def __init__(self, vectors: DataFrame, k: int = 5, bits: int = 8, most: int = 20_000, lists: int = 64, scratch: Scratch | None = None):
        """``vectors``: vec_id, embedding.  ``k``: the most neighbours to be asked for; ``bits``: rotations, so bits a dimension."""
        self.spark, self.k = vectors.sparkSession, k
        self.scratch = scratch or Scratch(self.spark, "nearest")
        whole = self._plain(vectors)
        sizes = whole.groupBy(F.size("embedding").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
        self.dim = sizes[0]["dim"] if sizes else 1
        self.vectors = self._classes(whole.where(F.size("embedding") == self.dim))
        self.rows = self.vectors.count()
        sample = self.vectors.select("embedding", F.xxhash64("key").alias("at"), "key").orderBy("at", "key").limit(most).toArrow()
        x = unit(_matrix(sample.column("embedding"), self.dim)) if sample.num_rows else np.zeros((0, self.dim))
        c = centres(x, max(1, min(lists, len(x) // 64))) if len(x) else np.ones((1, self.dim)) / math.sqrt(self.dim)
        self.shared = self.spark.sparkContext.broadcast((c, rotations(self.dim, bits)))
        coded = self.vectors.select("key", "embedding").mapInArrow(_coded(self.shared, self.dim), "key long, centre int, bits binary, scale float, spread float, bias float")
        self.codes = self.scratch.save(coded, "codes")

    @staticmethod
    def _plain(vectors: DataFrame) -> DataFrame:
        kind = vectors.schema["embedding"].dataType
        own = isinstance(kind, ArrayType) and isinstance(kind.elementType, (FloatType, DoubleType))
        e = F.col("embedding") if own else F.col("embedding").cast("array<double>")
        return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("embedding")).where(F.col("vec_id").isNotNull() & _valid("embedding"))

    def _classes(self, rows: DataFrame) -> DataFrame:
        """(key, ids, embedding): each distinct vector with its ``k`` + 1 smallest ids, which are all that can be asked for."""
        rank = F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))
        low = rows.distinct().withColumn("rank", rank).where(F.col("rank") <= self.k + 1)
        classes = low.groupBy("embedding").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
        # vectors that meet under one key by accident are both scored
        return self.scratch.save(classes.select(F.xxhash64("embedding", "ids").alias("key"), "ids", "embedding"), "vectors")

    def _queries(self, queries: DataFrame) -> DataFrame:
        own = self._plain(queries).where(F.size("embedding") == self.dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
        return self.scratch.save(own.withColumnRenamed("vec_id", "query_id"), "queries")

    def _pairs(self, queries: DataFrame, sure: float | None, keep: int | None) -> DataFrame:
        """(query_id, key, guess) of codes and queries in groups, each pair of groups one unit of work."""
        least = min(2 * self.spark.sparkContext.defaultParallelism, -(-self.rows // 1024))
        g, h = max(1, least, -(-self.rows // CODES)), max(1, -(-queries.count() // QUERIES))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
        codes = self.codes.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(g))).select("*", every(h).alias("h"))
        asked = queries.withColumn("h", F.pmod(F.xxhash64("query_id"), F.lit(h))).select("*", every(g).alias("g"))
        return codes.groupBy("g", "h").cogroup(asked.groupBy("g", "h")).applyInArrow(_scan(self.shared, self.dim, sure, keep), "query_id long, key long, guess double")

    def _best(self, pairs: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        """query_id, rank, vec_id, score of the best ``k`` of ``pairs`` (query_id, key), on original vectors."""
        wanted = pairs.select("key").distinct()
        wanted = broadcast_if(self.scratch.save(wanted, f"wanted-{self.steps}"), F.lit(1), 1_000_000)
        vectors = self.vectors.join(wanted, "key", "left_semi").withColumnRenamed("embedding", "vector")
        asked = broadcast_if(queries.select("query_id", F.col("embedding").alias("query")), F.lit(self.dim), 2_000_000)
        both = pairs.select("query_id", "key").join(vectors, "key").join(asked, "query_id").select("query_id", "ids", "vector", "query")
        scored = both.mapInArrow(_scored(self.dim), "query_id long, vec_id long, score double")
        scored = scored.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return scored.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    def search(self, queries: DataFrame, k: int | None = None, sure: float | None = 2.5) -> DataFrame:
        """query_id, rank, vec_id, score for ``queries`` (vec_id, embedding), a query's own id left out."""
        k = self.k if k is None else k
        if not 0 < k <= self.k:
            raise ValueError(f"k must be from 1 to {self.k}, which the index was made for")
        self.steps = 0
        queries = self._queries(queries)
        guessed = self._pairs(queries.withColumn("floor", F.lit(0.0)), sure, 2 * k + 1)
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("guess"), "key"))
        guessed = self.scratch.save(guessed.withColumn("rank", rank).where(F.col("rank") <= 2 * k + 1), "guessed")
        reached = self._best(guessed, queries, k).where(F.col("rank") == k).select("query_id", F.col("score").alias("floor"))
        floored = self.scratch.save(queries.join(reached, "query_id", "left").select("query_id", "embedding", F.coalesce("floor", F.lit(-2.0)).alias("floor")), "floored")
        self.scratch.drop("guessed", "wanted-0")
        self.survivors = self.scratch.save(self._pairs(floored, sure, None), "survivors")
        self.steps = 1
        return self._best(self.survivors, queries, k)

    def share_scored(self) -> float:
        """Of the last search: survivors by pairs of a query and a vector."""
        asked = self.survivors.select("query_id").distinct().count()
        return self.survivors.count() / max(1, asked * self.rows)


def report(embeddings: DataFrame, every: int = 50, k: int = 5, **options) -> DataFrame:
    """The contract's rows: the k nearest of each query."""
    return Index(embeddings, k, **options).search(embeddings.where(F.col("vec_id") % every == 0), k)
