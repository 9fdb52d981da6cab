"""Best-fit packing of tokenized documents into sequences, with a bounded number of open bins.

Each packing task keeps at most `open_bins` bins open, in a bitset keyed by free space: bit f is set if an open bin has f
free tokens, so the fullest bin that still fits a piece is the lowest set bit at or above its length. A piece that fits
nowhere opens a bin; if too many are open, the fullest closes first. Only documents longer than a sequence are cut.

Nulls: a null text counts as empty and makes one piece, the end id. Rows that share a doc_id stay apart. An empty table
makes no piece. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, release, stored
from .tokens import END_ID, coder

CAPACITY = 4096
#: With pieces in buffers of BUFFER, this many open bins cost 0.04 % more sequences than the words need at least (sf0.1); half as many 2 %.
OPEN_BINS = 256
#: Pieces that arrive together, on average: the longest of them is placed first.
BUFFER = 2048
#: Pieces of a packing task, on average.
PIECES_PER_TASK = 100_000
#: Pieces with ids that a task holds as arrays at a time.
ROWS = 1000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids themselves as little-endian 16-bit numbers."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, at = coder(vocabulary).flat(batch.column(1))
            sizes = np.diff(at) + 1
            n_parts = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(sizes)), n_parts)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n_parts) - n_parts, n_parts)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            crc, raw = [], []
            for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True):
                x = ids[at[d] + s : min(at[d] + s + n, at[d + 1])]
                if len(x) < n:
                    x = np.append(x, np.uint16(END_ID))
                crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                if keep_ids:
                    raw.append(x.astype("<u2").tobytes())
            out = [batch.column(0).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                out.append(pa.array(raw, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)
        release()

    return rows.mapInArrow(cut, _PIECES + (", ids binary" if keep_ids else ""))


class BestFit:
    """Open bins in a bitset keyed by free space."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.bits, self.open, self.made = 0, 0, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def place(self, length: int) -> tuple[int, int]:
        """The number of the bin that takes a piece, and the offset there."""
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            held = self.bins[free]
            number = held.pop()
            if not held:
                self.bits ^= 1 << free
            self.open -= 1
        else:
            number, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            if self.open >= self.open_bins:
                fullest = (self.bits & -self.bits).bit_length() - 1
                held = self.bins[fullest]
                held.pop(0)
                if not held:
                    self.bits ^= 1 << fullest
                self.open -= 1
            self.bins[left].append(number)
            self.bits |= 1 << left
            self.open += 1
        return number, self.capacity - free


def _unpacked(ids: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Ids of 16 bits as lists of numbers, and the crc32 of each row's ids as little-endian 32-bit numbers."""
    rows = [np.frombuffer(x, "<u2") for x in ids.to_pylist()]
    at, flat = np.cumsum([0, *map(len, rows)]), np.concatenate(rows).astype("<i4")
    crc = [zlib.crc32(flat[a:b].data) for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(flat)), pa.array(crc, pa.int64())


def pack(cut: DataFrame, n_pieces: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """Adds sequence_id and offset to pieces. n_pieces: their number, which sets the number of tasks and buffers.

    Pieces are dealt to tasks and their buffers by a hash, and a task takes the longest of each buffer first, so reruns agree.
    Bins stay open from one buffer to the next.
    If the pieces hold their ids, those become an array and ids_crc32 is taken again from the ids as they are packed.
    """
    tasks = max(1, -(-n_pieces // PIECES_PER_TASK))
    names = [f.name for f in cut.schema]
    hashed = F.xxhash64("doc_id", "piece", "start", "length", "ids_crc32")
    keyed = cut.withColumns({"_task": F.pmod(hashed, F.lit(tasks)).cast("int"), "_buffer": F.pmod(F.shiftright(hashed, 20), F.lit(max(1, n_pieces // tasks // BUFFER)))})
    dealt = keyed.repartitionById(tasks, "_task").sortWithinPartitions("_task", "_buffer", F.desc("length"), "doc_id", "piece", "ids_crc32")
    schema = ", ".join([*(f"{f.name} {'array<int>' if f.name == 'ids' else f.dataType.simpleString()}" for f in cut.schema), "sequence_id long", "offset long"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bins = None, None
        for batch in parts(batches, ROWS) if "ids" in names else batches:
            numbers, offsets = [], []
            for t, n in zip(batch.column("_task").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if t != task:
                    task, bins = t, BestFit(capacity, open_bins)
                number, offset = bins.place(n)
                numbers.append((t << 32) + number)
                offsets.append(offset)
            held = {x: batch.column(x) for x in names}
            if "ids" in held:
                held["ids"], held["ids_crc32"] = _unpacked(held["ids"])
            yield pa.RecordBatch.from_arrays([*held.values(), pa.array(numbers, pa.int64()), pa.array(offsets, pa.int64())], [*names, "sequence_id", "offset"])

    return dealt.mapInArrow(fit, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, keep_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack. The pieces are written once, since their number is needed before they are dealt."""
    cut = stored(pieces(docs, vocabulary, capacity, keep_ids=keep_ids), "pieces")
    return pack(cut, cut.count(), capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids (all of its pieces in place) and doc_ids, from pieces with ids. A sequence holds at most 4096 ids."""
    row = F.struct("offset", "doc_id", "piece", "ids")
    held = F.array_sort(F.collect_list(row))
    return packed.groupBy("sequence_id").agg(held.alias("_held")).select("sequence_id", F.flatten(F.col("_held.ids")).alias("ids"), F.col("_held.doc_id").alias("doc_ids"))
