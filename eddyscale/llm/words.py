"""Words of whole Arrow columns as hashes, without a Python object for each.

A word is a run of bytes that aren't ASCII white space (or that a table of one's own leaves).  Its
hash takes its length and its bytes eight at a time, each eight mixed before the next come in; a
word of more than ``LONG`` bytes goes through xxh3.  Columns go in chunks that end between words, so
neither a dictionary nor the length of a text takes memory.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

#: Of each byte: whether it is white space, and the byte with A-Z lowered.
BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[0x41:0x5B] += 32
#: Bytes beyond which a word is hashed by itself.
LONG = 256
#: The first n bytes of eight.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads bits (64-bit finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Classes of bytes: upper- and lower-case letters and digits; all others.
OTHER, UPPER, LOWER, DIGIT = 0, 1, 2, 3
CLASS = np.zeros(256, np.uint8)
CLASS[0x41:0x5B], CLASS[0x61:0x7B], CLASS[0x30:0x3A] = UPPER, LOWER, DIGIT


def latin(part: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes with the letters of ASCII and Latin-1 lowered, and their classes; both bytes of a letter are of its class."""
    low, kind = part.copy(), CLASS[part]
    low[kind == UPPER] += 32
    lead = np.flatnonzero(part[:-1] == 0xC3) if len(part) else np.empty(0, np.int64)
    tail = part[lead + 1] if len(lead) else lead
    for name, own in ((UPPER, (tail < 0x9F) & (tail != 0x97)), (LOWER, (tail >= 0x9F) & (tail != 0xB7))):
        at = lead[own]
        kind[at] = kind[at + 1] = name
        if name == UPPER:
            low[at + 1] += 32
    return low, kind


@dataclass
class Words:
    """``data``: the column's bytes; of each word its place, end and hash; of each text where its bytes and words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    offsets: np.ndarray
    bounds: np.ndarray


def eights(data: np.ndarray) -> np.ndarray:
    """At each byte the number that it and the next seven make; zeros follow the last."""
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    return np.ndarray((len(data) + 1,), "<u8", padded.data, 0, (1,))


def blocks(data: np.ndarray, first: np.ndarray, end: np.ndarray, most: int) -> np.ndarray:
    """(block, run): the first ``most`` times eight bytes of each run, zeros beyond its end."""
    at, size = eights(data), end - first
    out = np.zeros((most, len(first)), np.uint64)
    for k in range(most):
        own = np.flatnonzero(size > 8 * k) if k else slice(None)
        out[k, own] = at[first[own] + 8 * k] & _FIRST[np.minimum(size[own] - 8 * k, 8)]
    return out


def hashes(data: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the runs of bytes from ``first`` to ``end``, wherever they are."""
    at, size = eights(data), end - first
    h = size.astype(np.uint64) * _ODD
    h = mix(h ^ (at[first] & _FIRST[np.minimum(size, 8)]))
    own, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(own):
        h[own] = mix(h[own] ^ (at[first[own] + k] & _FIRST[np.minimum(size[own] - k, 8)]))
        k += 8
        own = own[size[own] > k]
    whole = memoryview(np.ascontiguousarray(data))
    for i in np.flatnonzero(size > LONG).tolist():
        h[i] = xxhash.xxh3_64_intdigest(whole[first[i] : end[i]])
    return h


class Hasher:
    def __init__(self, lowered: bool = False, chunk: int = 1 << 18, blank: np.ndarray = BLANK):
        self.lowered, self.chunk, self.blank = lowered, chunk, blank

    def _end(self, data: np.ndarray, at: int) -> int:
        """Where a chunk that begins at ``at`` ends: between two words."""
        end = min(len(data), at + self.chunk)
        while end < len(data):
            if len(gap := np.flatnonzero(self.blank[data[end - 1 : end + self.chunk]])):
                return end + int(gap[0])
            end = min(len(data), end + self.chunk)
        return end

    def chunks(self, data: np.ndarray, offsets: np.ndarray):
        """(place, bytes, starts, ends) of chunks that end between words, of the words in each."""
        at = 0
        while at < len(data):
            end = self._end(data, at)
            part = data[at:end]
            solid = ~self.blank[part]
            first, last = solid.copy(), solid.copy()
            first[1:] &= ~solid[:-1]
            last[:-1] &= ~solid[1:]
            # a word also ends where its text does
            own = offsets[np.searchsorted(offsets, at + 1) : np.searchsorted(offsets, end)] - at
            first[own] = solid[own]
            last[own - 1] = solid[own - 1]
            yield at, part, np.flatnonzero(first), np.flatnonzero(last) + 1
            at = end

    def __call__(self, texts: pa.Array) -> Words:
        """A null text has no words."""
        data, offsets = bytes_of(texts)
        starts, ends, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
        for at, part, first, end in self.chunks(data, offsets):
            found.append(hashes(LOWERED[part] if self.lowered else part, first, end))
            starts.append(first + at)
            ends.append(end + at)
        places = np.concatenate(starts)
        return Words(data, places, np.concatenate(ends), np.concatenate(found), offsets, np.searchsorted(places, offsets))


def bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's bytes, and where each text's begin."""
    texts = texts.cast(pa.large_string()) if not pa.types.is_large_string(texts.type) else texts
    _, places, buffer = texts.buffers()
    offsets = np.frombuffer(places, np.int64)[texts.offset : texts.offset + len(texts) + 1] if places else np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(buffer or b"", np.uint8)[int(offsets[0]) : int(offsets[-1])], offsets - offsets[0]


def texts_of(batch: pa.RecordBatch, name: str = "text") -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))
