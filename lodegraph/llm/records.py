"""Token ids as length-delimited binary records with masked checksums, and an offset index for shuffled reads.

A shard is a file of records: length (8 bytes, little-endian), masked crc32c of those 8 bytes (4), payload, masked crc32c
of the payload (4). A payload is the ids of one document, unsigned little-endian integers of 2 bytes. Beside `N.rec` lies
`N.idx`: for each record its document's number, offset and payload length (3 signed 64-bit integers), so a reader can
visit records in any order. A checksum is masked by rotating it 15 bits to the right and adding 0xa282ead8.

Nulls: a null text counts as empty and a null doc_id comes first (its index entry holds the least 64-bit number). Rows that share a doc_id
stay apart, ordered by a hash of the text. An empty table makes no file and no row. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Files, fresh_dir, release
from .tokens import END_ID, coder

MASK_DELTA = 0xA282EAD8
NULL_ID = -(2**63)
#: Bytes of records that a writer or reader holds at once.
CHUNK = 16 << 20


def _byte_table() -> np.ndarray:
    crc = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, (crc >> 1) ^ np.uint32(0x82F63B78), crc >> 1).astype(np.uint32)
    return crc


_ONE = _byte_table()


def _shift_tables(doublings: int) -> list[np.ndarray]:
    """For each k, four tables that append 2**k zero bytes to a checksum, one for each of its bytes."""
    basis = np.uint32(1) << np.arange(32, dtype=np.uint32)
    image = (basis >> np.uint32(8)) ^ _ONE[basis & np.uint32(255)]
    out = []
    for _ in range(doublings):
        tables = np.zeros((4, 256), np.uint32)
        for byte in range(4):
            for bit in range(8):
                tables[byte, np.flatnonzero(np.arange(256) >> bit & 1)] ^= image[8 * byte + bit]
        out.append(tables)
        image = _apply(tables, image)
    return out


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


_SHIFTS = _shift_tables(32)


def crc32c(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Castagnoli checksums of data[starts:ends] for many records at once, by pairwise combination of block checksums.

    Zero bytes before a message leave a checksum that starts from 0 alone, so records of like size are padded in front to
    the same power of two; starting from all ones is the same as inverting the first four bytes.
    """
    sizes = ends - starts
    out = np.zeros(len(sizes), np.uint32)
    levels = np.ceil(np.log2(np.maximum(sizes, 4))).astype(int)
    for level in np.unique(levels):
        rows = np.flatnonzero(levels == level)
        step = max(1, CHUNK >> level)
        for k in range(0, len(rows), step):
            some = rows[k : k + step]
            width = 1 << level
            block = np.zeros((len(some), width), np.uint8)
            start = np.full(len(some), 0, np.uint32)
            for j, r in enumerate(some):
                n = sizes[r]
                if n >= 4:
                    block[j, width - n :] = data[starts[r] : ends[r]]
                    block[j, width - n : width - n + 4] ^= 255
                else:
                    start[j] = zlib_free(bytes(data[starts[r] : ends[r]]))
            crc = _ONE[block]
            for k2 in range(level):
                crc = _apply(_SHIFTS[k2], crc[:, 0::2]) ^ crc[:, 1::2]
            out[some] = np.where(sizes[some] >= 4, crc[:, 0] ^ np.uint32(0xFFFFFFFF), start)
    return out


def zlib_free(data: bytes) -> int:
    """The same checksum of a few bytes, one after another."""
    crc = 0xFFFFFFFF
    for x in data:
        crc = crc >> 8 ^ int(_ONE[(crc ^ x) & 255])
    return crc ^ 0xFFFFFFFF


def masked(crc: np.ndarray) -> np.ndarray:
    crc = crc.astype(np.uint32)
    return (crc >> np.uint32(15) | crc << np.uint32(17)) + np.uint32(MASK_DELTA)


def frame(payload: np.ndarray, at: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Records of payload[at[k]:at[k+1]], and the offset of each."""
    sizes = np.diff(at)
    heads = sizes.astype("<u8").view(np.uint8).reshape(-1, 8)
    line = np.arange(len(sizes), dtype=np.int64) * 8
    head_crc = masked(crc32c(heads.reshape(-1), line, line + 8)).astype("<u4")
    body_crc = masked(crc32c(payload, at[:-1], at[1:])).astype("<u4")
    offsets = at[:-1] + 16 * np.arange(len(sizes))
    out = bytearray()
    raw = payload.tobytes()
    for k in range(len(sizes)):
        out += heads[k].tobytes() + head_crc[k].tobytes() + raw[at[k] : at[k + 1]] + body_crc[k].tobytes()
    return bytes(out), offsets


def write_records(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[str, list[tuple[int, int, int]]]:
    """Write every document's ids, ascending by id_col over the shards. Returns the folder and (shard, documents, ids) in order.

    One row for each shard reaches the driver.
    """
    spark = docs.sparkSession
    at = fresh_dir(spark, "records")
    Files(at).make()
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, files, counts, index = TaskContext.get().partitionId(), Files(at), [0, 0], []

        def chunks():
            begun = 0
            for batch in batches:
                if not batch.num_rows:
                    continue
                ids, ends = coder(vocabulary).flat(batch.column(1))
                extra = np.arange(len(ends))
                whole = np.empty(len(ids) + batch.num_rows, "<u2")
                last = ends[1:] + extra[:-1]
                keep = np.ones(len(whole), bool)
                keep[last] = False
                whole[keep], whole[last] = ids, END_ID
                framed, offsets = frame(whole.view(np.uint8), 2 * (ends + extra))
                numbers = batch.column(0).fill_null(NULL_ID).to_numpy(zero_copy_only=False)
                index.append(np.column_stack([numbers, offsets + begun, 2 * np.diff(ends + extra)]).astype("<i8"))
                begun += len(framed)
                counts[0] += batch.num_rows
                counts[1] += len(whole)
                yield framed

        first = next(stream := chunks(), None)
        if first is None:
            return
        files.write(f"{number}.rec", (x for part in ([first], stream) for x in part))
        files.write(f"{number}.idx", (x.tobytes() for x in index))
        release()
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([counts[0]], pa.int64()), pa.array([counts[1]], pa.int64())], ["shard", "n_docs", "n_ids"])

    # the hash lets a range end between rows of one doc_id
    keyed = rows.withColumn("_hash", F.xxhash64("text"))
    parts = keyed.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text")
    done = parts.mapInArrow(shard, "shard long, n_docs long, n_ids long").collect()
    return at, sorted(tuple(x) for x in done)


def read_shard(at: str, shard: int) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Document numbers and ids of a shard, some at a time, each record's lengths and checksums verified."""
    files = Files(at)
    with files.open(f"{shard}.idx") as f:
        index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
    with files.open(f"{shard}.rec") as f:
        k = 0
        while k < len(index):
            n = max(1, int(np.searchsorted(index[k:, 1], index[k, 1] + CHUNK)))
            some = index[k : k + n]
            f.seek(int(some[0, 1]))
            data = np.frombuffer(f.read(int(some[-1, 1] + some[-1, 2] + 16 - some[0, 1])), np.uint8)
            starts = some[:, 1] - some[0, 1]
            ends = starts + 12 + some[:, 2]
            fields = np.stack([data[s : s + 12] for s in starts])
            tails = np.stack([data[e : e + 4] for e in ends])
            good = fields[:, :8].copy().view("<u8")[:, 0] == some[:, 2]
            good &= fields[:, 8:].copy().view("<u4")[:, 0] == masked(crc32c(data, starts, starts + 8))
            good &= tails.copy().view("<u4")[:, 0] == masked(crc32c(data, starts + 12, ends))
            if not good.all():
                raise ValueError(f"shard {shard}: record {k + int(np.argmin(good))} is damaged")
            yield some[:, 0], [data[s + 12 : e].view("<u2") for s, e in zip(starts, ends, strict=True)]
            k += n


def read_one(at: str, shard: int, position: int) -> tuple[int, np.ndarray]:
    """One record by its place in the index, as a shuffled reader fetches it."""
    files = Files(at)
    with files.open(f"{shard}.idx") as f:
        f.seek(24 * position)
        number, offset, size = np.frombuffer(f.read(24), "<i8")
    with files.open(f"{shard}.rec") as f:
        f.seek(int(offset))
        data = np.frombuffer(f.read(int(size) + 16), np.uint8)
    if int(data[12 + size :].view("<u4")[0]) != int(masked(crc32c(data, np.array([12]), np.array([12 + size])))[0]):
        raise ValueError("the record is damaged")
    return int(number), data[12 : 12 + size].view("<u2")


def read_records(spark, at: str, shards: list[tuple[int, int, int]]) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every record, read from the files."""
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not shards:
        return spark.createDataFrame([], schema)
    starts = np.cumsum([0, *(n for *_, n in shards)]).tolist()
    plan = spark.createDataFrame([(s, starts[k]) for k, (s, *_) in enumerate(shards)], "shard long, start long").repartition(len(shards), "shard")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begun = row["start"]
                for numbers, ids in read_shard(at, row["shard"]):
                    sizes = np.array([len(x) for x in ids])
                    at_ = begun + np.cumsum(sizes) - sizes
                    begun += int(sizes.sum())
                    crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
                    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64(), mask=numbers == NULL_ID), pa.array(at_), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return plan.mapInArrow(digest, schema)
