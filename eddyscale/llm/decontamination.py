"""Benchmark decontamination by a generalised suffix automaton.

Benchmark items become sequences of word ids and one automaton accepts every substring of
every item.  A document's words are streamed through it; at each word the automaton holds the
longest suffix read so far that occurs in some item.  Where that suffix is at least a window
long, the words of the window are hit, and the state reached by shortening it to a window tells
which items hold it.  Items shorter than a window count as one window of their own length.

Scale: one map over the documents, no shuffle; texts are tokenised once.  Items are taken in chunks
of a bounded number of words, an automaton each, built once a Python worker and kept as arrays; an
item longer than a chunk is cut into parts that overlap by a window less one word, so that every
window is in some part.  A worker holds ``GROUP`` automata at most and runs them one after another:
a benchmark of more words takes another pass over what the one before has written.

Defined results: null or empty texts have no words and are clean; items without words are
ignored; items of null id hit words but aren't listed; the longest match of an item that was cut
is that within a part; repeated rows are judged one by one, and
repeated items are one; texts are read whole, whatever their length; an empty benchmark leaves
every document clean, an empty table gives an empty one; there are no ties.  Columns of any name
come back as they were; what is found takes an underscore in front where a column is named so.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, column_list, fold, free, pieces, quoted, unfold, with_fields

#: Automata that a worker holds at a time.
GROUP = 16

#: Words are runs of digits, letters and everything beyond ASCII; A-Z is lowered.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)
_WORD = re.compile(rb"[^\x20]+")


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


class SuffixAutomaton:
    """Of several sequences; state 0 is the root."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int, link: int, arcs: dict[int, int]) -> int:
        self.next.append(arcs)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state of exactly the strings of ``p`` followed by ``c``, carved out of ``q`` if need be."""
        if self.length[q] == self.length[p] + 1:
            return q
        new = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = new
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = new
            p = self.link[p]
        return new

    def add(self, sequence: list[int]) -> None:
        last = 0
        for c in sequence:
            if c in self.next[last]:
                last = self._split(last, c, self.next[last][c])
                continue
            new, p = self._state(self.length[last] + 1, 0, {}), last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = new
                p = self.link[p]
            if p != -1:
                self.link[new] = self._split(p, c, self.next[p][c])
            last = new

    def compact(self) -> None:
        """No more sequences: arcs as arrays, those of states that have several as a dictionary each."""
        self.branches = {s: arcs for s, arcs in enumerate(self.next) if len(arcs) > 1}
        single = [next(iter(arcs.items())) if len(arcs) == 1 else (0, 0) for arcs in self.next]
        self.symbol, self.target = array("i", [c for c, _ in single]), array("i", [t for _, t in single])
        self.link, self.length = array("i", self.link), array("i", self.length)
        self.next = []

    def walk(self, sequence):
        """(state, longest matching length) after each symbol, a number from 1."""
        if self.next:
            self.compact()
        state = n = 0
        symbol, target, branches, link, length = self.symbol, self.target, self.branches, self.link, self.length
        for c in sequence:
            while True:
                if symbol[state] == c:
                    to = target[state]
                    break
                to = branches[state].get(c, 0) if state in branches else 0
                if to or not state:
                    break
                state = link[state]
                n = length[state]
            if to:
                state = to
                n += 1
            yield state, n


class Matcher:
    """Items (id, text) compiled for scanning; ``vocabulary``: numbers of words, from 1, that other matchers use too."""

    def __init__(self, items: list[tuple[object, str | None]], window: int, vocabulary: dict[bytes, int] | None = None):
        self.window, self.automaton = window, SuffixAutomaton()
        self.vocabulary = {} if vocabulary is None else vocabulary
        sequences, own = [], set()
        for item, text in items:
            if ids := [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]:
                sequences.append((None if item is None else str(item), ids))
                self.automaton.add(ids)
                own.update(ids)
        self.own, self._mask = np.fromiter(own, np.int64, len(own)), np.zeros(0, bool)
        self.shortest = min((min(len(s), window) for _, s in sequences), default=0)
        self.automaton.compact()
        link, length = self.automaton.link, self.automaton.length
        order = sorted(range(len(link)), key=length.__getitem__)
        #: of each state of at least a window: the state that holds its suffix of a window
        self.anchor = array("i", [0] * len(link))
        for s in order:
            if length[s] >= window:
                self.anchor[s] = s if length[link[s]] < window else self.anchor[link[s]]
        self.items: dict[int, set] = {}
        self.short: dict[int, set] = {}
        for item, ids in sequences:
            for s, n in self.automaton.walk(ids):
                if n >= window:
                    self.items.setdefault(self.anchor[s], set()).add(item)
            if len(ids) < window:
                self.short.setdefault(s, set()).add(item)
        #: of each state: the nearest state on its suffix path, itself included, that is a short item
        self.nearest = array("i", [0] * len(link))
        if self.short:
            for s in order[1:]:
                self.nearest[s] = s if s in self.short else self.nearest[link[s]]

    def _is_own(self) -> np.ndarray:
        """Of each number whether the word is in these items; made again where others have added words."""
        if len(self._mask) <= len(self.vocabulary):
            self._mask = np.zeros(len(self.vocabulary) + 1, bool)
            self._mask[self.own] = True
        return self._mask

    def numbers(self, tokens: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.vocabulary.get, tokens, [0] * len(tokens)), np.int32, len(tokens))

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        return self.scan_numbers(self.numbers(tokens))

    def scan_numbers(self, ids: np.ndarray) -> tuple[list[tuple[int, int]], set, int]:
        """Hit spans [start, end) in order, items whose windows occur, the longest match (exact from a window up)."""
        if not self.shortest or len(ids) < self.shortest:
            return [], set(), 0
        mine = self._is_own()[ids]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], mine, [False])).astype(np.int8)))
        spans, found, longest = [], set(), 0
        length, link, window = self.automaton.length, self.automaton.link, self.window
        for start, end in edges.reshape(-1, 2).tolist():
            if end - start < self.shortest:
                continue  # no window fits between two words that no item has
            for at, (s, n) in enumerate(self.automaton.walk(ids[start:end].tolist()), start + 1):
                longest = max(longest, n)
                back = 0
                if n >= window:
                    found |= self.items[self.anchor[s]]
                    back = window
                if self.short:
                    near = self.nearest[s]
                    if near == s and n < length[s]:
                        near = self.nearest[link[s]]
                    while near:
                        found |= self.short[near]
                        back = max(back, length[near])
                        near = self.nearest[link[near]]
                if back:
                    if spans and spans[-1][1] >= at - back:
                        low = min(spans[-1][0], at - back)
                        while len(spans) > 1 and spans[-2][1] >= low:
                            spans.pop()
                            low = min(low, spans[-1][0])
                        spans[-1] = (low, at)
                    else:
                        spans.append((at - back, at))
        return spans, found, longest


class Matchers:
    """Several matchers over one vocabulary."""

    def __init__(self, chunks: list[list[tuple[object, str | None]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        self.parts = [Matcher(items, window, self.vocabulary) for items in chunks]

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, int]], set, int]:
        """What all of them find; words are looked up once."""
        if len(self.parts) == 1:
            return self.parts[0].scan(tokens)
        ids, spans, found, longest = self.parts[0].numbers(tokens), [], set(), 0
        for part in self.parts:
            some, items, most = part.scan_numbers(ids)
            spans += some
            found |= items
            longest = max(longest, most)
        return merge(spans), found, longest


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the characters from the first to the last word of each span."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_TABLE))]
    kept, end = [], 0
    for a, b in spans:
        kept.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*kept, raw[end:]]).decode("utf-8", "surrogatepass")


_FOUND = "n_words long, n_hit long, longest_match int, items array<string>, starts array<int>, ends array<int>"
_NAMES = ("n_words", "n_hit", "longest_match", "items", "starts", "ends")
#: The last matchers of this Python worker, by their broadcast's name: workers outlive tasks.
_MATCHERS: dict[str, Matchers] = {}


def _matcher(name: str, shared, window: int) -> Matchers:
    if name not in _MATCHERS:
        _MATCHERS.clear()
        _MATCHERS[name] = Matchers(shared.value, window)
    return _MATCHERS[name]


def _scan(name: str, shared, window: int, again: bool):
    """Rows of kept, text and what is found; ``again``: added to what an earlier pass has found."""
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32())]

    def run(batches):
        matcher = _matcher(name, shared, window)
        for batch in pieces(batches):
            made: list[list] = [[] for _ in kinds]
            before = zip(*(column_list(batch, n) for n in ("items", "starts", "ends", "longest_match")), strict=True) if again else None
            for text in column_list(batch, "text"):
                tokens = words(text)
                spans, found, longest = matcher.scan(tokens)
                found.discard(None)
                if before is not None:
                    listed, starts, ends, most = next(before)
                    spans, found, longest = merge([*spans, *zip(starts, ends, strict=True)]), found.union(listed), max(longest, most)
                for out, value in zip(made, (len(tokens), sum(b - a for a, b in spans), longest, sorted(found), [a for a, _ in spans], [b for _, b in spans]), strict=True):
                    out.append(value)
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in ("kept", "text")), *(pa.array(v, t) for v, t in zip(made, kinds, strict=True))], names=["kept", "text", *_NAMES])

    return run


def _cut(batches):
    """Rows of kept and the text without its spans."""
    for batch in pieces(batches):
        texts = [cut(t, list(zip(a, b, strict=True))) if a else t for t, a, b in zip(*(column_list(batch, n) for n in ("text", "starts", "ends")), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("kept")), pa.array(texts, pa.string())], names=["kept", "text"])


def _parts(window: int, most: int):
    """Items of more than ``most`` words in parts that overlap by a window less one word."""

    def run(batches):
        for batch in pieces(batches):
            ids, texts = [], []
            for item, text in zip(column_list(batch, "item_id"), column_list(batch, "text"), strict=True):
                own = words(text)
                if len(own) <= most:
                    ids.append(item)
                    texts.append(text)
                    continue
                for at in range(0, len(own) - window + 1, most - window + 1):
                    ids.append(item)
                    texts.append(b" ".join(own[at : at + most]).decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field("item_id").type), pa.array(texts, pa.string())], names=["item_id", "text"])

    return run


def _found(rows: DataFrame, benchmark: DataFrame, window: int, chunk_words: int, group: int = GROUP) -> DataFrame:
    """``rows`` (kept, text) with what is found in them."""
    spark, schema = rows.sparkSession, with_fields(rows.schema, _FOUND)
    most = max(chunk_words, 2 * window)
    items = benchmark.select("item_id", "text")
    items = items.mapInArrow(_parts(window, most), items.schema)
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = 1 + int(total) // (chunk_words * 4)  # a word takes two bytes at least; half the bound, for an uneven deal
    scratch = Scratch(spark, "decontamination") if chunks > group else None
    for first in range(0, chunks, group):
        chunk = F.pmod(F.xxhash64("item_id", "text"), F.lit(chunks)).cast("int")
        dealt: list[list] = [[] for _ in range(min(group, chunks - first))]
        for r in items.withColumn("chunk", chunk).where(F.col("chunk").between(first, first + len(dealt) - 1)).collect():  # bounded: about group * chunk_words words
            dealt[r["chunk"] - first].append((r["item_id"], r["text"]))
        shared = spark.sparkContext.broadcast([d for d in dealt if d] or [[]])
        if first:
            rows = scratch.save(rows, f"pass-{first}")
        rows = rows.mapInArrow(_scan(uuid.uuid4().hex, shared, window, first > 0), schema)
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 13, keep: tuple[str, ...] = ("doc_id",), chunk_words: int = 100_000) -> DataFrame:
    """``keep`` columns, ``text`` and, for each row, the words, hit words, longest match, item ids and hit spans."""
    cols = list(dict.fromkeys([*keep, "text"]))
    found = _found(fold(docs.select(*map(quoted, cols)), "text"), benchmark, window, chunk_words)
    return unfold(found, cols, *(F.col(n).alias(free(n, cols)) for n in _NAMES))


def _limit(n_hit, n_words, share: int):
    return (n_hit > 0) & (share * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = 13, share: int = 20, mode: str = "drop", chunk_words: int = 100_000) -> DataFrame:
    """Documents without benchmark passages, all columns kept.

    ``drop`` leaves out documents of which at least one word in ``share`` is hit; ``cut`` keeps
    every document and removes the hit spans from its text.
    """
    if mode not in ("drop", "cut"):
        raise ValueError(f"mode: {mode!r}")
    rows = fold(docs, "text")
    found = _found(rows, benchmark, window, chunk_words)
    if mode == "drop":
        return unfold(found.where(~_limit(F.col("n_hit"), F.col("n_words"), share)), docs.columns)
    return unfold(found.mapInArrow(_cut, rows.schema), docs.columns)


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's row of each document."""
    found = contamination(docs.select("doc_id", "text"), benchmark)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        _limit(F.col("n_hit"), F.col("n_words"), 20).alias("contaminated"),
    )


def brute(text: str | None, items: list[tuple[object, str | None]], window: int = 13) -> tuple[int, int, int, str, bool]:
    """What ``report`` must say, by comparing every position with every window."""
    t, hit, found = words(text), set(), set()
    for item, body in items:
        w = words(body)
        n = min(window, len(w))
        grams = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(t) - n + 1 if n else 0):
            if tuple(t[i : i + n]) in grams:
                hit |= set(range(i, i + n))
                if item is not None:
                    found.add(str(item))
    return len(t), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(t)
