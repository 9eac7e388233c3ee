"""Packing by concatenating and cutting: documents' tokens lie one after another on one line, which fixed windows cut.

1.  Each task tokenises its texts and writes every document's ids with how many of the task's
    tokens lie before it.
2.  Two prefix sums (``offsets``), over tasks in a block and over blocks, give every task's place on
    the line and so every document's.
3.  A map cuts each document where windows end.  A piece's row says in which window it lies and
    where, so documents and windows needn't meet in a task: nothing is shuffled but totals.

Padding: all windows but the last are full.  The last is cut at the binary digits of its length,
longest first, so that each of its sequences is a power of two; with ``tail="pad"`` it stays one
window that is padded.

Scale: texts are tokenised once; ids are written in two bytes where the vocabulary allows it, read
once, and dropped as soon as pieces are cut.  A document of any length is one row of ids, and its
pieces leave in batches of bounded size; no task holds more than an Arrow batch.  A lost task is
made again from written tables, so places stay as they were.

Defined results: a null or empty text is one token, the end; repeated rows and null ids are packed
each; the order on the line is that of the tasks' rows, so ties don't arise; an empty table gives no
pieces.  Kept columns of any name come back as they were; a result's column takes an underscore in
front where a kept one is named so.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from . import offsets
from .common import Scratch, free, pieces, quoted, unfold, with_fields
from .packing import default_tokenizer, encoder
from .words import texts_of

#: Bytes of ids in a batch of pieces, about.
_BATCH = 4 << 20


def _widths(path: str, end: int) -> str:
    """Two bytes a token where every id fits in them."""
    return "<u2" if max(encoder(path).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end) < 1 << 16 else "<u4"


def _tokenised(path: str, end: int):
    def run(batches):
        encode, width, part, seen = encoder(path), _widths(path, end), TaskContext.get().partitionId(), 0
        for batch in pieces(batches, rows=2000, max_bytes=_BATCH):
            found, bounds = encode.column(texts_of(batch))
            # each text's ids and the end's
            line = np.insert(found, bounds[1:], end).astype(width)
            n = np.diff(bounds) + 1
            at = np.concatenate(([0], np.cumsum(n)))
            kept = batch.column(batch.schema.get_field_index("kept"))
            ids = pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer((at * line.itemsize).astype(np.int64)), pa.py_buffer(line)])
            yield pa.RecordBatch.from_arrays([kept, pa.array(np.full(len(n), part)), pa.array(seen + at[:-1]), pa.array(n), ids.cast(pa.binary())], names=["kept", "part", "local", "doc_tokens", "ids"])
            seen += int(at[-1])

    return run


def tail_cuts(total: int, capacity: int, tail: str = "powers") -> np.ndarray:
    """Where the sequences after the last full window begin, and the line's end."""
    if tail not in ("powers", "pad"):
        raise ValueError(f"tail: {tail!r}")
    first = total - total % capacity
    rest, cuts = total - first, [first]
    while rest:
        size = 1 << (rest.bit_length() - 1) if tail == "powers" else rest
        cuts.append(cuts[-1] + size)
        rest -= size
    return np.array(cuts, np.int64)


def _cut(capacity: int, cuts: np.ndarray, width: str):
    """Pieces of each document, in batches of bounded size."""
    last_window = int(cuts[0]) // capacity

    def sequence(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and first position of the sequences that hold these positions."""
        own = np.searchsorted(cuts, at, side="right") - 1
        full = own < 0
        return np.where(full, at // capacity, last_window + own), np.where(full, at - at % capacity, cuts[np.maximum(own, 0)])

    def edges(start: int, end: int) -> np.ndarray:
        """Positions of a document's pieces, and its end."""
        full = np.arange((start // capacity + 1) * capacity, min(end, int(cuts[0]) + 1), capacity)
        inner = np.concatenate(([start], full, cuts[1:], [end]))
        return np.unique(inner[(inner >= start) & (inner <= end)])

    def run(batches):
        for batch in pieces(batches, rows=4000, max_bytes=_BATCH):
            where = {n: i for i, n in enumerate(batch.schema.names)}
            take, rows, ids, size = [], [], [], 0

            def made():
                start, length, at, tokens = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                number, first = sequence(at)
                kept = batch.column(where["kept"]).take(pa.array(take, pa.int64()))
                return pa.RecordBatch.from_arrays([kept, pa.array(start), pa.array(length), pa.array(tokens), pa.array(number), pa.array(at - first), pa.array(ids, pa.binary())], names=["kept", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])

            places, counts, held = batch.column(where["position"]).to_pylist(), batch.column(where["doc_tokens"]).to_pylist(), batch.column(where["ids"])
            for i, (place, n) in enumerate(zip(places, counts, strict=True)):
                line = np.frombuffer(held[i].as_buffer(), width).astype("<u4")
                cut = edges(place, place + n) if place // capacity != (place + n - 1) // capacity or place + n > cuts[0] else np.array([place, place + n])
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    rows.append((a - place, b - a, a, n))
                    ids.append(line[a - place : b - place].tobytes())
                    take.append(i)
                    size += 4 * (b - a)
                    if size > _BATCH:
                        yield made()
                        take, rows, ids, size = [], [], [], 0
            if rows:
                yield made()

    return run


_PIECE = "start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def pack(docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end: int = 2, tail: str = "powers", keep: tuple[str, ...] = ("doc_id",), scratch: Scratch | None = None) -> DataFrame:
    """``keep`` columns and each piece's start, length, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit)."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity is a power of two")
    scratch, path = scratch or Scratch(docs.sparkSession, "concatenation"), tokenizer or default_tokenizer()
    rows = docs.select(F.struct(*([F.col(quoted(c)).alias(c) for c in keep] or [F.lit(0).alias("none")])).alias("kept"), "text")
    made = rows.mapInArrow(_tokenised(path, end), with_fields(rows.select("kept").schema, "part long, local long, doc_tokens long, ids binary"))
    line = scratch.save(made, "line")  # written, since places hold for one deal only
    bases = scratch.save(offsets.before(line.select("part", F.col("doc_tokens").alias("total"))), "bases")
    total = line.agg(F.sum("doc_tokens")).first()[0] or 0
    at = offsets.placed(line, bases, F.col("local"), "position")
    cut = at.select("kept", "position", "doc_tokens", "ids").mapInArrow(_cut(capacity, tail_cuts(total, capacity, tail), _widths(path, end)), with_fields(rows.select("kept").schema, _PIECE))
    names = [n.split()[0] for n in _PIECE.split(", ")]
    return unfold(cut, list(keep), *(F.col(n).alias(free(n, list(keep))) for n in names))


def sequences(packed: DataFrame, key: str = "doc_id") -> DataFrame:
    """(sequence_id, ids array<int>, boundaries): a row for each sequence, of at most ``capacity`` tokens.

    A boundary record for each piece, in order: its offset and length, the document it is of, where in it
    it starts, and whether the document goes on in the next sequence, for masks and positions.
    """
    piece = F.struct("offset", "length", F.col(quoted(key)).alias("document"), "start", (F.col("start") + F.col("length") < F.col("doc_tokens")).alias("goes_on"), "ids")
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    rows = rows.select("sequence_id", F.transform("pieces", lambda p: p["ids"]).alias("ids"), F.transform("pieces", lambda p: p.dropFields("ids")).alias("boundaries"))
    schema = StructType([f if f.name != "ids" else StructField("ids", ArrayType(IntegerType())) for f in rows.schema.fields])

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("ids")
            made = [np.frombuffer(b"".join(parts), "<i4") for parts in batch.column(at).to_pylist()]
            ends = np.cumsum([0, *map(len, made)]).astype(np.int32)
            yield batch.set_column(at, "ids", pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, "<i4"), *made]))))

    return rows.mapInArrow(run, schema)


def report(docs: DataFrame, **options) -> DataFrame:
    """The contract's row of each piece."""
    packed = pack(docs.select("doc_id", "text"), **options)
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
