"""Size-aware heavy-light Jaccard join of word-shingle sets.

Sets are those of five-word shingles; two documents link at a Jaccard similarity of 0.8.  A
global order puts shingles that many documents share last, so that two linking sets meet in
the first fifth of both (their prefixes).

* Light sets (few shingles): every pair of shingles in the prefix that must hold two common
  ones is a key.  Such keys hit almost only sets that link, but their number grows with the
  square of the size.
* Heavy sets: each shingle of the prefix is a key; its documents are the shingle's inverted
  list, to be scanned.
* Light sets that are large enough to link with a heavy one are in the inverted lists too.

The boundary between the two is the size at which the summed cost of keys and list entries
over all documents is least.  Every candidate is checked on the whole sets.

Equal sets are one class from the start.  For components, the members of each key are first
compared with one of them, the one that shares most of its prefix; what then is in one component needs no further comparing, and only
pairs across components are checked after that, first by a bitmap of each set, then on the sets.  So a group of thousands of near copies costs
links in proportion to its members, and none between different components is lost.

The order needs the shared shingles only roughly: each task counts the shingles that it meets
more than once, over all documents, and the ``frequent`` most counted are broadcast.  Others
count as rare.  Any order gives the same result, a worse one more candidates.

Scale: keys are a fifth of the shingles, 24 bytes each, shuffled once; whole sets are shuffled
of documents with a candidate only.  Keys of one document are dropped where they are read.

Defined results: null, empty or blank texts have no shingles and link with nothing; fewer than
five words make one shingle; rows of one id are one document; rows of null id have a null
component and link nothing; texts are read whole, whatever their length; there are no ties, since
a component is named by its smallest id; an empty table gives an empty result.  Columns of any
name come back as they were.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import Scratch, column_list, free, pieces
from .words import Hasher, mix, texts_of

#: Odd multipliers of the words of a shingle, and those of the finaliser.
_PLACE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
_LIGHT_MOST = 128  # largest boundary that is weighed


class Shingler:
    """Distinct shingle hashes of texts, for a whole Arrow column at once."""

    def __init__(self, width: int = 5, chunk: int = 1 << 18):
        self.width, self.words = width, Hasher(lowered=True, chunk=chunk)

    def sets(self, texts: pa.Array):
        """Each text's distinct shingles' hashes, sorted; none for a null text."""
        found, w = self.words(texts), self.width
        h, total = found.hashes, np.empty(0, np.uint64)
        if len(h) >= w:
            total = h[: len(h) - w + 1] * _PLACE[0]
            for i in range(1, w):
                total += h[i : len(h) - w + 1 + i] * _PLACE[i]
            total = mix(total)
        for a, b in zip(found.bounds[:-1].tolist(), found.bounds[1:].tolist(), strict=True):
            if b - a >= w:
                s = np.sort(total[a : b - w + 1])
                fresh = s[1:] != s[:-1]
                yield s if fresh.all() else s[np.concatenate(([True], fresh))]
            elif b > a:
                yield mix(np.array([(h[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.empty(0, np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        return next(self.sets(pa.array([text], pa.string())))


def needed(n):
    """Least overlap of a set of n with a linking one."""
    return (4 * n + 4) // 5


def _identity(s: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _measure(width: int, chunk: int):
    """Rows of documents (0, id, size, identity) and of shingles met more than once (1, hash, times)."""

    def run(batches):
        shingle, seen, held, size = Shingler(width), set(), [], 0

        def counted():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            values, times = values[times > 1].view(np.int64), times[times > 1]
            z = np.zeros(len(values), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(len(values), np.int32)), pa.array(values), pa.array(times), pa.array(z), pa.array(z)], names=["kind", "a", "b", "c", "d"])

        for batch in pieces(batches):
            rows = []
            for doc, s in zip(column_list(batch, "doc_id"), shingle.sets(texts_of(batch)), strict=True):
                who = _identity(s)
                rows.append((0, doc, len(s), *who))
                if who not in seen:
                    seen.add(who)
                    held.append(s)
                    size += len(s)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), [pa.int32()] + [pa.int64()] * 4, strict=True)], names=["kind", "a", "b", "c", "d"])
            if size > chunk:
                yield counted()
                held, size = [], 0
        if held:
            yield counted()

    return run


def boundary(sizes: dict[int, int], length: float) -> int:
    """The largest light size: least cost in keys and list entries, lists being ``length`` long on average."""
    most = max([n for n in sizes if n <= _LIGHT_MOST], default=0)

    def cost(b: int) -> float:
        total = 0.0
        for n, docs in sizes.items():
            if n <= 3 or n > _LIGHT_MOST:
                continue
            spare = n - needed(n)
            listed = (spare + 1) * (1 + length)
            if n <= b:
                total += docs * ((spare + 2) * (spare + 1) / 2 + (listed if n >= needed(b + 1) else 0))
            else:
                total += docs * listed
        return total

    return min(range(3, max(4, most + 1)), key=lambda b: (cost(b), b))


def keys_of(s: np.ndarray, order: tuple[np.ndarray, np.ndarray], light: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a set, and the place in the ordered set of each; of light keys, -1 less their second shingle's."""
    n = len(s)
    frequent, times = order
    if n <= 3:  # links with equal sets only
        return mix(s.sum(dtype=np.uint64, keepdims=True) + np.uint64(n)), np.full(1, -1, np.int32)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, s), len(frequent) - 1)
        weight = np.where(frequent[at] == s, times[at], 0)
        if weight.any():
            s = s[np.argsort(weight, kind="stable")]
    spare = n - needed(n)
    keys, places = [], []
    if n <= light:
        i, j = np.array(list(combinations(range(spare + 2), 2)), np.int64).T
        keys.append(mix(s[i] * _PLACE[1] + s[j] * _PLACE[2]))
        places.append(-1 - j)
    if n > light or n >= needed(light + 1):
        keys.append(s[: spare + 1])
        places.append(np.arange(spare + 1))
    return np.concatenate(keys), np.concatenate(places)


def _emit(width: int, shared, light: int):
    def run(batches):
        shingle, seen = Shingler(width), set()
        for batch in pieces(batches):
            keys, nodes, sizes, places = [], [], [], []
            for doc, s in zip(column_list(batch, "doc_id"), shingle.sets(texts_of(batch)), strict=True):
                if doc is None or not len(s) or (who := _identity(s)) in seen:
                    continue
                seen.add(who)
                k, p = keys_of(s, shared.value, light)
                keys.append(k)
                places.append(p)
                nodes.append(np.full(len(k), doc, np.int64))
                sizes.append(np.full(len(k), len(s), np.int32))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(sizes)), pa.array(np.concatenate(places).astype(np.int32))], names=["key", "node", "n", "place"])

    return run


def _several(batches):
    """Of rows sorted by key, those whose key more than one row has."""
    last = None  # one row held back
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch] if last is None else [last[0], batch])
        keys = table.column("key").to_numpy()
        same = keys[1:] == keys[:-1]
        more = np.concatenate(([last is not None and last[1]], same)) | np.concatenate((same, [False]))
        if len(keys) > 1:
            yield from table.slice(0, len(keys) - 1).filter(pa.array(more[:-1])).to_batches()
        last = (table.slice(len(keys) - 1).combine_chunks().to_batches()[0], bool(more[-1]))
    if last is not None and last[1]:
        yield last[0]


def _sets(width: int, sent: bool):
    """(to, node, set): a document's set, to each node in its list ``others`` if it is sent, else to itself."""

    def run(batches):
        shingle = Shingler(width)
        for batch in pieces(batches, rows=500):
            to, docs, sets = [], [], []
            lists = column_list(batch, "others") if sent else [None] * batch.num_rows
            for doc, s, others in zip(column_list(batch, "doc_id"), shingle.sets(texts_of(batch)), lists, strict=True):
                s = s.view(np.int64)
                for other in others if sent else [doc]:
                    to.append(other)
                    docs.append(doc)
                    sets.append(s)
                    if len(to) >= 500:
                        yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(docs, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["to", "node", "set"])
                        to, docs, sets = [], [], []
            yield pa.RecordBatch.from_arrays([pa.array(to, pa.int64()), pa.array(docs, pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["to", "node", "set"])

    return run


def _bits(width: int):
    """(node, n, bits): which of 2048 buckets a document's set reaches."""

    def run(batches):
        shingle = Shingler(width)
        for batch in pieces(batches, rows=500):
            sizes, maps = [], []
            for s in shingle.sets(texts_of(batch)):
                reached = np.zeros(2048, bool)
                reached[(s >> np.uint64(53)).astype(np.int64)] = True
                sizes.append(len(s))
                maps.append(np.packbits(reached).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("doc_id")), pa.array(sizes, pa.int32()), pa.array(maps, pa.binary())], names=["node", "n", "bits"])

    return run


def _near(batches):
    """Pairs that may link: a bucket that one set alone reaches holds a shingle that isn't common."""
    for batch in batches:
        n = (batch.column("n").to_numpy() + batch.column("n_").to_numpy()).astype(np.int64)
        x, y = (np.frombuffer(b"".join(column_list(batch, c)), np.uint8).reshape(-1, 256) for c in ("bits", "bits_"))
        apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
        ok = pa.array(9 * ((n - apart) // 2) >= 4 * n)
        yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], names=["a", "b"])


def checked_broadcast(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Broadcast if there are at most so many rows, of a few numbers each; else Spark shuffles."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


class Join:
    """One run over ``docs``; its tables are in ``scratch``."""

    def __init__(self, docs: DataFrame, width: int = 5, frequent: int = 200_000, chunk: int = 2_000_000, scratch: Scratch | None = None):
        self.width, self.frequent = width, frequent
        self.docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        self.spark = docs.sparkSession
        self.scratch = scratch or Scratch(self.spark, "jaccard-join")
        measured = self.scratch.save(self.docs.mapInArrow(_measure(width, chunk), "kind int, a long, b long, c long, d long"), "measured")
        sized = measured.where("kind = 0").select(F.col("a").alias("doc_id"), F.col("b").alias("n"), F.col("c").alias("i1"), F.col("d").alias("i2"))
        classes = sized.where("n > 0 and doc_id is not null").groupBy("n", "i1", "i2").agg(F.min("doc_id").alias("class"))
        classes = self.scratch.save(classes, "classes")  # so that the join below is one that splits hot keys
        one = sized.where("n > 0").join(classes, ["n", "i1", "i2"], "left").select("doc_id", "n", F.when(F.col("doc_id").isNotNull(), F.col("class")).alias("class"))
        self.members = self.scratch.save(one.unionByName(sized.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("class"))), "members")
        self.order, self.light = self._order(measured)
        self.groups = self._groups()
        self.scratch.drop("measured", "classes", "times")

    def _order(self, measured: DataFrame):
        """Frequent shingles by hash with their counts, and the boundary."""
        times = self.scratch.save(measured.where("kind = 1").groupBy("a").agg(F.sum("b").alias("times")).where("times > 3"), "times")
        sizes = {r["n"]: r["docs"] for r in self.members.where(f"n between 1 and {_LIGHT_MOST}").groupBy("n").agg(F.count("*").alias("docs")).collect()}
        levels = times.groupBy(F.floor(F.log2("times") * 4).cast("int").alias("level")).agg(F.count("*").alias("k"), F.sum(F.col("times") * F.col("times")).alias("squares")).orderBy(F.desc("level")).collect()
        taken, least, squares = 0, 0.0, 0.0
        for r in levels:  # whole levels, from the most frequent down, as far as they fit
            if taken + r["k"] <= self.frequent and not least:
                taken += r["k"]
            else:
                least = least or 2.0 ** ((r["level"] + 1) / 4)
                squares += r["squares"]
        total = self.members.agg(F.sum("n")).first()[0] or 1
        table = times.where(F.col("times") >= least - 1e-6).toArrow()  # at most self.frequent rows
        values = table.column("a").to_numpy().astype(np.int64).view(np.uint64)
        by = np.argsort(values)
        return (values[by], table.column("times").to_numpy()[by]), boundary(sizes, 1 + squares / total)

    def _groups(self) -> DataFrame:
        """(key, node, n, place, hub) of keys that more than one class has; nodes are classes.

        ``hub``: the share of the node's prefix that is shared, most in a text that others are
        edited from.
        """
        shared = self.spark.sparkContext.broadcast(self.order)
        keys = self.docs.mapInArrow(_emit(self.width, shared, self.light), "key long, node long, n int, place int")
        dealt = keys.repartition("key").sortWithinPartitions("key")
        some = self.scratch.save(dealt.mapInArrow(_several, "key long, node long, n int, place int"), "several")
        named = some.join(self.members.where("n > 0").select(F.col("doc_id").alias("node"), "class").distinct(), "node")
        named = self.scratch.save(named.groupBy("key", F.col("class").alias("node")).agg(F.first("n").alias("n"), F.min("place").alias("place")), "named")
        two = named.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
        listed = F.count(F.when(F.col("place") >= 0, 1)).over(Window.partitionBy("node"))
        groups = named.join(two, "key", "left_semi").select("*", (listed / (F.floor(F.col("n") / 5) + 1)).alias("hub"))
        groups = self.scratch.save(groups, "groups")
        self.scratch.drop("several", "named")
        return groups

    def verified(self, pairs: DataFrame, name: str) -> DataFrame:
        """Those of the distinct ``pairs`` (a, b) that link, on whole sets.

        The set of b is made where its text is read and goes to a once for each pair; that of a
        is moved once.
        """
        pairs = self.scratch.save(pairs.select("a", "b").distinct(), f"{name}-pairs")
        lists = self.scratch.save(pairs.groupBy(F.col("b").alias("doc_id")).agg(F.collect_list("a").alias("others")), f"{name}-lists")
        heads = self.scratch.save(pairs.select(F.col("a").alias("doc_id")).distinct(), f"{name}-heads")
        kind = "to long, node long, set array<long>"
        few = pairs.limit(1_000_001).count() <= 1_000_000  # a list's entries count, not its rows
        sent = self.docs.join(F.broadcast(lists) if few else lists, "doc_id").mapInArrow(_sets(self.width, True), kind)
        own = self.docs.join(checked_broadcast(heads), "doc_id", "left_semi").mapInArrow(_sets(self.width, False), kind)
        joined = sent.join(own.select("to", F.col("set").alias("own")), "to")
        both = F.size(F.array_intersect("set", "own"))
        links = joined.where(100 * both >= 80 * (F.size("set") + F.size("own") - both)).select(F.col("to").alias("a"), F.col("node").alias("b"))
        return self.scratch.save(links, f"{name}-links")

    def _screened(self, pairs: DataFrame, name: str) -> DataFrame:
        """Without pairs that 256 bytes of each set show to be too different; none that links is lost."""
        pairs = self.scratch.save(pairs.select("a", "b").distinct(), f"{name}-candidates")
        ids = self.scratch.save(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), f"{name}-ids")
        bits = self.docs.join(checked_broadcast(ids), "doc_id", "left_semi").mapInArrow(_bits(self.width), "node long, n int, bits binary")
        bits = self.scratch.save(bits, f"{name}-bits")
        both = pairs.join(bits.toDF("a", "n", "bits"), "a").join(bits.toDF("b", "n_", "bits_"), "b")
        return both.select("a", "b", "n", "n_", "bits", "bits_").mapInArrow(_near, "a long, b long")

    @staticmethod
    def _may_link():
        """Whether sizes and places of two rows of one key, the second's columns with _, allow a link.

        All that two sets have in common lies at or behind their first common shingle, so at the
        key of that one both must have enough left.  Light keys hold their first two.
        """
        left = lambda s: F.when(F.col(f"place{s}") < 0, F.col(f"n{s}") + 2 + F.col(f"place{s}")).otherwise(F.col(f"n{s}") - F.col(f"place{s}"))
        size, size_ = F.col("n"), F.col("n_")
        return (5 * F.least(size, size_) >= 4 * F.greatest(size, size_)) & (9 * F.least(left(""), left("_")) >= 4 * (size + size_))

    def _pairs(self, rows: DataFrame, extra: str = "true") -> DataFrame:
        """Pairs of one key whose sizes and places allow a link.

        Sizes that link differ by less than one band, so a key's list is cut into bands and the
        smaller set meets only its own and the next.
        """
        band = F.floor(F.log(F.col("n").cast("double")) / 0.2231)
        large = rows.select(*(F.col(c).alias(f"{c}_" if c != "key" else c) for c in rows.columns), band.alias("band"))
        small = rows.select("*", F.explode(F.array(band, band + 1)).alias("band"))
        smaller = (F.col("n") < F.col("n_")) | (F.col("n") == F.col("n_")) & (F.col("node") < F.col("node_"))
        pairs = small.join(large, ["key", "band"]).where(smaller & self._may_link() & F.expr(extra))
        return pairs.select(F.least("node", "node_").alias("a"), F.greatest("node", "node_").alias("b"))

    def links(self) -> DataFrame:
        """(a, b), a < b: every link between different classes, by their smallest ids."""
        return self.verified(self._screened(self._pairs(self.groups), "every"), "every")

    def components(self) -> DataFrame:
        """doc_id, n, component: the smallest id reachable by links."""
        band = F.floor(F.log(F.col("n").cast("double")) / 0.2231)
        hub = F.max_by(F.struct("node", "n", "place"), F.struct("hub", -F.col("node"))).alias("h")
        hubs = self.groups.groupBy("key", band.alias("band")).agg(hub).select("key", "band", *(F.col(f"h.{c}").alias(f"{c}_") for c in ("node", "n", "place")))
        stars = self.groups.withColumn("band", band).join(hubs, ["key", "band"]).where((F.col("node") != F.col("node_")) & self._may_link())
        # the hub receives
        stars = stars.select(F.col("node_").alias("a"), F.col("node").alias("b"))
        first = self.verified(stars, "star")
        label = graph.components(first, self.scratch, "stars")
        marked = self.groups.join(label, "node", "left").withColumn("component", F.coalesce("component", "node"))
        marked = self.scratch.save(marked, "marked")
        mixed = marked.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        rest = self._pairs(marked.join(mixed, "key", "left_semi"), "component <> component_")
        done = self.spark.read.parquet(f"{self.scratch.root}/star-pairs").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        second = self.verified(self._screened(rest.distinct().join(done, ["a", "b"], "left_anti"), "rest"), "rest")
        if second.limit(1).count():
            # only what the first links made is joined further: edges of the second kind are between components
            ends = second.join(label.toDF("a", "ca"), "a", "left").join(label.toDF("b", "cb"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
            joined = graph.components(ends, self.scratch, "rest")
            whole = label.join(joined.toDF("component", "top"), "component", "left").select("node", F.coalesce("top", "component").alias("component"))
            label = whole.unionByName(joined.toDF("node", "component").join(label.select("node"), "node", "left_anti"))
        self.scratch.drop("marked", *(f"{k}-{part}" for k in ("star", "rest") for part in ("candidates", "ids", "bits", "pairs", "lists", "heads", "links")))
        return self.members.join(label.withColumnRenamed("node", "class"), "class", "left").select("doc_id", "n", F.coalesce("component", "class").alias("component"))


def near_copies_dropped(docs: DataFrame, **options) -> DataFrame:
    """All columns; of each component the rows of the smallest id, and rows of null id."""
    join = Join(docs, **options)
    name = free("dropped", docs.columns)
    found = join.scratch.save(join.components().where("doc_id <> component").select(F.col("doc_id").alias(name)).distinct(), "dropped")
    return docs.join(checked_broadcast(found), docs["doc_id"] == found[name], "left_anti")


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's row of each document."""
    return Join(docs, **options).components().select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))
