"""Best-fit packing of token sequences with exact-complement hashing.

Only lengths matter for a plan, and there are no more lengths than the capacity: the plan is
made on the histogram of piece lengths.  Sums of one, two and three lengths are indexed by sum.
From the longest length down, the gap is looked up for a combination that fills it exactly, and
as many sequences as the counts allow are made of each.  What finds no exact complement is
packed by best fit, decreasing.  A plan is a list of patterns, each with a count.

Pieces then find their places without meeting: a piece's rank among those of its length points
into the plan's intervals.  Ranks come from each task's counts of each length.

Scale: texts are tokenised once, in a map; a piece's row holds no ids.  The plan has at most a
few thousand patterns whatever the input, and is made on the driver from at most ``capacity``
counts.

Defined results: null or empty texts are one token, the end; only documents longer than the
capacity are cut, however long they are; repeated rows are packed each, null ids as well; pieces
of one length are alike, so ties need no rule; an empty table gives no sequences.  Kept columns
of any name come back as they were; a result's column takes an underscore in front where a kept
one is named so.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, free, pieces, quoted, unfold, with_fields
from .words import LOWER, UPPER, Hasher, blocks, bytes_of, hashes, latin, texts_of

#: Bytes of ASCII punctuation.
_PUNCTUATION = np.zeros(256, bool)
_PUNCTUATION[[*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself where printable, else from 256 up."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Eights of bytes of a unit that is remembered, at most.
_HELD = 3


class Encoder:
    """Token ids of whole columns.

    The vocabulary drops white space and lowers case, and none of its tokens spans white space:
    a text's ids are those of its words one after another.  A plain word, Latin letters with a tail
    of ASCII punctuation, is its lowered letters and its tail; any other goes to the library whole.
    Such units are found by hash and remembered, in a table of fixed size whose slots hold the last
    unit that fell there: its length and its bytes, which are compared, so that no two units are
    taken for one.  Units of more than ``_HELD`` times eight bytes are tokenised each time.  Their
    ids lie in one array, which is begun anew at ``most`` ids.
    """

    def __init__(self, path: str, bits: int = 19, most: int = 2_000_000):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.shift = Tokenizer.from_file(path), most, np.uint64(64 - bits)
        self.letters, self.hasher = _byte_letters(), Hasher()
        self.held, self.entries = np.zeros((_HELD + 1, 1 << bits), np.uint64), np.zeros(1 << bits, np.int64)
        self._clear()

    def _clear(self) -> None:
        self.held[:] = 0  # no unit has the length 0
        self.ids, self.sizes, self.places = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def _part(self, text: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(text.encode().decode("latin-1").translate(self.letters))]

    def _whole(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _units(self, data: np.ndarray, offsets: np.ndarray):
        """Of each chunk: its bytes, lowered too, where its words begin, and in order its units' words, starts, ends, kinds, hashes and bytes."""
        for at, part, first, end in self.hasher.chunks(data, offsets):
            low, kind = latin(part)
            letter = (kind == UPPER) | (kind == LOWER)
            here = np.arange(len(part) + 1)
            # of each place, the first one from there on that isn't a letter, or isn't punctuation
            beyond = lambda mark: np.minimum.accumulate(np.where(np.append(mark, False), len(part), here)[::-1])[::-1]
            cut = np.minimum(beyond(letter)[first], end)
            plain = beyond(_PUNCTUATION[part])[cut] >= end
            word = np.arange(len(first))
            lead, tail = plain & (cut > first), plain & (end > cut)
            before = np.cumsum(lead.astype(np.int64) + tail + ~plain) - lead - tail - ~plain  # units of the words in front
            rows, units, at_place = [], [], []
            for which, mask, start, stop in ((0, lead, first, cut), (1, tail, cut, end), (2, ~plain, first, end)):
                at_place.append(before[mask] + (lead[mask] if which == 1 else 0))
                own, start, stop = part if which else low, start[mask], stop[mask]
                rows.append((word[mask], start, stop, np.full(len(start), which), hashes(own, start, stop) ^ np.uint64(which * 0x9E3779B97F4A7C15 & (1 << 64) - 1)))
                # the kind and the length in front of the bytes
                units.append(np.vstack([(3 * (stop - start) + which).astype(np.uint64)[None], blocks(own, start, stop, _HELD)]))
            word, start, stop, which, h = (np.concatenate(x) for x in zip(*rows, strict=True))
            order = np.empty(len(word), np.int64)
            order[np.concatenate(at_place)] = np.arange(len(word))
            yield at, part, low, first, word[order], start[order], stop[order], which[order], h[order], np.concatenate(units, axis=1)[:, order]

    def _known(self, part: np.ndarray, low: np.ndarray, start, stop, which, h, unit) -> np.ndarray:
        """The entry of each unit, new ones made."""
        if len(self.ids) > self.most:
            self._clear()
        slot = (h >> self.shift).astype(np.int64)
        out = self.entries[slot]
        missed = np.flatnonzero((self.held[:, slot] != unit).any(0) | (stop - start > 8 * _HELD))
        if len(missed):
            _, first, inverse = np.unique(h[missed], return_index=True, return_inverse=True)
            at = missed[first]
            # what has another's hash, or is too long to be compared, is by itself
            alone = missed[(unit[:, missed] != unit[:, at[inverse]]).any(0) | (stop[missed] - start[missed] > 8 * _HELD)]
            made = []
            every = np.concatenate((at, alone))
            for a, b, k in zip(start[every].tolist(), stop[every].tolist(), which[every].tolist(), strict=True):
                text = (part if k else low)[a:b].tobytes().decode()
                made.append(self._whole(text) if k == 2 else self._part(text))
            sizes = np.fromiter(map(len, made), np.int64, len(made))
            entry = len(self.sizes) + np.arange(len(made))
            self.places = np.concatenate((self.places, len(self.ids) + np.cumsum(sizes) - sizes))
            self.sizes = np.concatenate((self.sizes, sizes))
            self.ids = np.concatenate((self.ids, np.fromiter(chain.from_iterable(made), np.uint32, int(sizes.sum()))))
            out[missed] = entry[inverse]
            out[alone] = entry[len(at) :]
            self.held[:, slot[at]], self.entries[slot[at]] = unit[:, at], entry[: len(at)]
        return out

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, little-endian unsigned 32-bit numbers, and where each text's begin."""
        data, offsets = bytes_of(texts)
        ids, starts, counts = [np.empty(0, "<u4")], [np.empty(0, np.int64)], [np.zeros(1, np.int64)]
        for at, part, low, first, word, start, stop, which, h, unit in self._units(data, offsets):
            entry = self._known(part, low, start, stop, which, h, unit)
            sizes = self.sizes[entry]
            before = np.cumsum(sizes) - sizes
            ids.append(self.ids[np.repeat(self.places[entry] - before, sizes) + np.arange(int(sizes.sum()))].astype("<u4"))
            starts.append(first + at)
            counts.append(np.bincount(word, sizes, len(first)).astype(np.int64))
        bounds = np.searchsorted(np.concatenate(starts), offsets)
        return np.concatenate(ids), np.cumsum(np.concatenate(counts))[bounds]

    def __call__(self, text: str | None) -> bytes:
        return self.column(pa.array([text], pa.string()))[0].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Sums:
    """Sums of two and of three lengths, by sum: what fills a gap exactly is looked up.

    An entry of two is its larger length, one of three its first length, whose rest is an entry
    of two.  Counts only fall, so an entry that has run out is passed once and for all.
    """

    def __init__(self, left: list[int], capacity: int):
        self.left = left
        self.have = np.flatnonzero(left)
        self.two: list[list[int]] = [[] for _ in range(capacity + 1)]
        for a in self.have[::-1].tolist():  # so that each list falls
            for b in self.have[self.have <= min(a, capacity - a)].tolist():
                self.two[a + b].append(a)
        self.at = [0] * (capacity + 1)
        self.three: dict[int, list[int]] = {}

    def _lasts(self, a: int, b: int) -> bool:
        return self.left[a] > (a == b) and self.left[b] > 0

    def pairs(self, total: int):
        """The larger lengths of pairs of that sum that are there, longest first."""
        entries = self.two[total]
        while self.at[total] < len(entries) and not self._lasts(a := entries[self.at[total]], total - a):
            self.at[total] += 1
        for a in entries[self.at[total] :]:
            if self._lasts(a, total - a):
                yield a

    def firsts(self, total: int):
        """Lengths that with a pair make that sum, longest first."""
        if total not in self.three:
            self.three[total] = [x for x in self.have[::-1].tolist() if x < total and 3 * x >= total and self.two[total - x]]
        entries = self.three[total] = [x for x in self.three[total] if self.left[x] > 0]
        yield from entries


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with how many sequences follow each; every length is used up."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length}")
        left[length] = n
    patterns: dict[tuple[int, ...], int] = defaultdict(int)

    def take(pattern: tuple[int, ...]) -> bool:
        need = {x: pattern.count(x) for x in pattern}
        n = min(left[x] // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= n * k
        if n:
            patterns[tuple(sorted(pattern, reverse=True))] += n
        return n > 0

    def fill(long: int, gap: int) -> bool:
        if left[gap] > 0 and take((long, gap)):
            return True
        if any(take((long, a, gap - a)) for a in sums.pairs(gap)):
            return True
        return any(take((long, x, a, gap - x - a)) for x in sums.firsts(gap) for a in sums.pairs(gap - x))

    sums = Sums(left, capacity)
    for long in range(capacity, 0, -1):
        gap = capacity - long
        if gap == 0 and left[long]:
            take((long,))
        while gap > 0 and left[long] and fill(long, gap):
            pass
    # what is left, by best fit: open sequences are kept by gap, alike ones together
    gaps: list[int] = []
    opened: dict[int, list[list]] = defaultdict(list)

    def put(gap: int, pattern: tuple[int, ...], n: int) -> None:
        if not opened[gap]:
            insort(gaps, gap)
        opened[gap].append([pattern, n])

    for length in range(capacity, 0, -1):
        n = left[length]
        while n:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                pattern, had = opened[gap].pop()
                if not opened[gap]:
                    gaps.pop(at)
                used = min(n, had)
                if had > used:
                    put(gap, pattern, had - used)
                put(gap - length, (*pattern, length), used)
                n -= used
            else:
                each = capacity // length
                if n >= each:
                    put(capacity - each * length, (length,) * each, n // each)
                    n %= each
                else:
                    put(capacity - n * length, (length,) * n, 1)
                    n = 0
    for alike in opened.values():
        for pattern, n in alike:
            patterns[pattern] += n
    return sorted(patterns.items(), reverse=True)


def intervals(patterns: list[tuple[tuple[int, ...], int]], base: int) -> np.ndarray:
    """Rows (length * base + first rank, first sequence, offset), sorted: where a length's ranks go."""
    rows, used, sequence = [], defaultdict(int), 0
    for pattern, n in patterns:
        offset = 0
        for length in pattern:
            rows.append((length * base + used[length], sequence, offset))
            used[length] += n
            offset += length
        sequence += n
    return np.array(sorted(rows), np.int64).reshape(-1, 3)


_PIECE = "piece int, start long, length long, ids_crc32 long"


def _cut_up(path: str, capacity: int, end: int):
    tail = int(end).to_bytes(4, "little")
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]

    def run(batches):
        encode, seen, part = encoder(path), defaultdict(int), TaskContext.get().partitionId()
        for batch in pieces(batches, rows=2000, max_bytes=4 << 20):
            rows, take = [], []
            found, bounds = encode.column(texts_of(batch))
            for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                ids = found[a:b].tobytes() + tail
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    one = ids[at : at + 4 * capacity]
                    length = len(one) // 4
                    rows.append((k, at // 4, length, zlib.crc32(one), part, seen[length]))
                    seen[length] += 1
                    take.append(i)
            kept = batch.column(batch.schema.get_field_index("kept")).take(pa.array(take, pa.int64()))
            yield pa.RecordBatch.from_arrays([kept, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=["kept", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return run


def _place(shared, base: int):
    def run(batches):
        table = shared.value
        for batch in batches:
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            key = batch.column("length").to_numpy(zero_copy_only=False) * base + rank
            at = np.searchsorted(table[:, 0], key, side="right") - 1
            own = batch.select([n for n in batch.schema.names if n != "rank"])
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(table[at, 1] + (key - table[at, 0])), pa.array(table[at, 2])], names=[*own.schema.names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end: int = 0, keep: tuple[str, ...] = ("doc_id",), scratch: Scratch | None = None) -> DataFrame:
    """``keep`` columns and each piece's piece, start, length, ids_crc32, sequence_id and offset."""
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "packing")
    kept = F.struct(*([F.col(quoted(c)).alias(c) for c in keep] or [F.lit(0).alias("none")]))
    rows = docs.select(kept.alias("kept"), "text")
    cut = rows.mapInArrow(_cut_up(tokenizer or default_tokenizer(), capacity, end), with_fields(rows.select("kept").schema, f"{_PIECE}, part int, nth long"))
    cut = scratch.save(cut, "pieces")  # written, since a task's counts hold for one deal only
    counts = cut.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = scratch.save(counts.withColumn("before", before), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    base = 1 << 48
    shared = spark.sparkContext.broadcast(intervals(plan(histogram, capacity), base))
    # the counts grow with the number of tasks, so they are merged, not broadcast
    ranked = cut.join(counts.select("part", "length", "before").hint("merge"), ["part", "length"]).withColumn("rank", F.col("before") + F.col("nth"))
    names = ["kept", "piece", "start", "length", "ids_crc32"]
    placed = ranked.select(*names, "rank").mapInArrow(_place(shared, base), with_fields(cut.select(*names).schema, "sequence_id long, offset long"))
    return unfold(placed, list(keep), *(F.col(n).alias(free(n, list(keep))) for n in [*names[1:], "sequence_id", "offset"]))


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's row of each piece."""
    return pack(docs.select("doc_id", "text"), **options)
