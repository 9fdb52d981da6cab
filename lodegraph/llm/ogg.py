"""Ogg media columns: pages with verified checksums, packets from lacing values, logical streams, times from granules.

`encode` stores a payload as a physical stream of two multiplexed logical streams: 8-bit mono samples at 8000 a second
(a header packet, then packets of up to 4096 samples; the granule position of a page is the number of samples up to its
last finished packet) and a caption stream that names the length. `parse` reads any Ogg bytes. Malformed pages and damaged
checksums are counted, never raised; a page that fails its checksum gives no packet, and a packet that lost a page is dropped,
the first page too. A first page on a serial number already seen begins a chained stream: `decode` puts the samples and lengths of
chained streams together, and counts streams of other content, or with an unusable header, as foreign.

A null text counts as empty: 64 zero samples. Equal texts give equal bytes. Null media parse as no page. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RATE = 8000
PACKET = 4096
#: Segments of a page, at most; PAGE_PACKETS whole packets fit into one page.
SEGMENTS = 255
UNIT = 64
_HEAD = struct.Struct("<4sBBqIIIB")
_NO_GRANULE = -1
_CONTINUED, _FIRST, _LAST = 1, 2, 4
_REVERSED = bytes(int(f"{x:08b}"[::-1], 2) for x in range(256))
_SAMPLES, _CAPTION = b"SAMPLE8U", b"CAPTIONS"
_SAMPLE_ID, _CAPTION_ID = 1, 2
FIELDS = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def page_crc(page: bytes) -> int:
    """Checksum with polynomial 0x04c11db7, most significant bit first, from 0: zlib's on bits reversed in each byte."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int(f"{crc:032b}"[::-1], 2)


class Writer:
    """Pages of one logical stream."""

    def __init__(self, serial: int):
        self.serial, self.sequence = serial, 0

    def page(self, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
        head = bytearray(_HEAD.pack(b"OggS", 0, flags, granule, self.serial, self.sequence, 0, len(lacing)))
        self.sequence += 1
        page = bytes(head) + lacing + body
        return page[:22] + struct.pack("<I", page_crc(page)) + page[26:]

    def pages(self, packets: list[tuple[bytes, int]], flags: int = 0, last: bool = False) -> list[bytes]:
        """Pages of (packet, granule position after it); a packet may run over several pages."""
        out, lacing, body, granule, begun = [], bytearray(), bytearray(), _NO_GRANULE, flags
        for packet, after in packets:
            segments = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
            at, done = 0, 0
            while done < len(segments):
                if len(lacing) == SEGMENTS:
                    out.append((begun, granule, bytes(lacing), bytes(body)))
                    lacing, body, granule, begun = bytearray(), bytearray(), _NO_GRANULE, _CONTINUED if done else 0
                take = segments[done : done + SEGMENTS - len(lacing)]
                n = sum(take)
                lacing += take
                body += packet[at : at + n]
                at, done = at + n, done + len(take)
            granule = after
        out.append((begun, granule, bytes(lacing), bytes(body)))
        return [self.page(f | _LAST * (last and k == len(out) - 1), g, x, b) for k, (f, g, x, b) in enumerate(out)]


def payload_of(text: str | None) -> tuple[bytes, int]:
    """UTF-8 bytes padded with zeros to a positive multiple of 64, and their number before."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def encode(payload: bytes, n_bytes: int) -> bytes:
    """A physical stream with the payload as samples and a caption with its length."""
    samples, captions = Writer(_SAMPLE_ID), Writer(_CAPTION_ID)
    out = samples.pages([(_SAMPLES + struct.pack("<II", RATE, 1), 0)], _FIRST)
    out += captions.pages([(_CAPTION + struct.pack("<I", RATE), 0)], _FIRST)
    body = [(payload[k : k + PACKET], min(k + PACKET, len(payload))) for k in range(0, len(payload), PACKET)]
    half = len(body) // 2
    if half:
        out += samples.pages(body[:half])
    out += captions.pages([(b"%d" % n_bytes, len(payload))], last=True)
    out += samples.pages(body[half:], last=True)
    return b"".join(out)


def parse(data: bytes | None) -> dict:
    """The logical streams of Ogg bytes by (serial number, place in the chain): packets with (end granule or None), and counts of what was found."""
    streams: dict[tuple[int, int], dict] = {}
    current: dict[int, dict] = {}
    pages = bad = 0
    at, data = 0, data or b""
    while (at := data.find(b"OggS", at)) >= 0 and at + 27 <= len(data):
        _, version, flags, granule, serial, sequence, crc, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        if version or len(lacing) < n or end > len(data):
            bad += 1
            at += 4
            continue
        page = data[at:end]
        if page_crc(page[:22] + bytes(4) + page[26:]) != crc:
            bad += 1
            at += 4
            continue
        pages += 1
        s = current.get(serial)
        if s is None or flags & _FIRST:  # a first page on a known serial begins a chained stream
            chain = sum(k == serial for k, _ in streams)
            s = current[serial] = streams[serial, chain] = {"packets": [], "open": b"", "whole": bool(flags & _FIRST), "next": sequence if flags & _FIRST else 0, "gaps": 0, "last": False}
        if sequence != s["next"]:  # a stream whose first page is lost has a gap before what is left
            s["gaps"] += 1
            s["open"], s["whole"] = b"", False
        if not flags & _CONTINUED:
            if s["open"]:  # the rest of a packet never came
                s["gaps"] += 1
            s["open"], s["whole"] = b"", True
        elif not s["open"]:  # the rest of a packet whose begin isn't here
            s["whole"] = False
        s["next"], s["last"] = sequence + 1, bool(flags & _LAST)
        body, k, finished = at + 27 + n, 0, []
        for value in re.findall(rb"\xff*[^\xff]|\xff+$", lacing, re.DOTALL):
            size = sum(value)
            part = data[body + k : body + k + size]
            k += size
            if value[-1] == 255:
                s["open"] += part
                break
            if s["whole"]:
                finished.append(s["open"] + part)
            s["open"], s["whole"] = b"", True
        s["packets"] += [(x, granule if j == len(finished) - 1 and granule != _NO_GRANULE else None) for j, x in enumerate(finished)]
        at = end
    return {"streams": streams, "pages": pages, "bad": bad}


def times(packets: list[tuple[bytes, int | None]], rate: int) -> list[tuple[float, float]]:
    """Start and end seconds of each packet of samples: known at the granule positions, counted back from the next one."""
    ends: list[int] = [0] * len(packets)
    known = None
    for k in range(len(packets) - 1, -1, -1):
        packet, granule = packets[k]
        known = granule if granule is not None else known
        ends[k] = known if known is not None else -1
        if known is not None:
            known -= len(packet)
    for k, end in enumerate(ends):  # after the last granule position: counted forward
        if end < 0:
            ends[k] = (ends[k - 1] if k else 0) + len(packets[k][0])
    return [((e - len(p)) / rate, e / rate) for (p, _), e in zip(packets, ends, strict=True)]


def decode(media: bytes | None) -> tuple[bytes, int | None, dict]:
    """The samples, the length that the caption names, and features of the physical stream."""
    found = parse(media)
    payload, n_bytes, spans, rate, odd = b"", None, [], RATE, 0
    for place in sorted(found["streams"]):
        packets = found["streams"][place]["packets"]
        head = packets[0][0] if packets else b""
        if head[:8] == _SAMPLES and len(head) >= 12 and (named := struct.unpack_from("<I", head, 8)[0]):
            rate = named
            payload += b"".join(x for x, _ in packets[1:])
            spans = times(packets[1:], rate)
        elif head[:8] == _CAPTION and len(packets) > 1 and re.fullmatch(rb"[0-9]{1,18}", packets[1][0]):
            n_bytes = (n_bytes or 0) + int(packets[1][0])
        else:
            odd += 1
    return payload, n_bytes, {
        "streams": len(found["streams"]),
        "pages": found["pages"],
        "bad_pages": found["bad"],
        "packets": sum(len(s["packets"]) for s in found["streams"].values()),
        "gaps": sum(s["gaps"] for s in found["streams"].values()),
        "ended": sum(s["last"] for s in found["streams"].values()),
        "foreign": odd,
        "rate": rate,
        "seconds": f"{spans[-1][1]:.4f}" if spans else "0.0000",
        "last_start": f"{spans[-1][0]:.4f}" if spans else "0.0000",
    }


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and a binary column `media` with each whole text as Ogg."""
    kind = docs.schema[id_col].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                media = [encode(*payload_of(x)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], [id_col, "media"])

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(pack, f"`{id_col}` {kind}, media binary")


def media_features(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What reading the stored bytes gives: lengths, digests and features of the streams. Null media: no payload."""
    kind = media.schema[id_col].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stored in batch.column(1).to_pylist():
                payload, n_bytes, seen = decode(stored)
                rows.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(stored or b""), hashlib.sha256(stored or b"").hexdigest(), ";".join(f"{k}={v}" for k, v in seen.items())))
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], [id_col, *(x.split()[0] for x in FIELDS.split(", "))])

    return media.select(F.col(id_col), F.col(media_col)).mapInArrow(read, f"`{id_col}` {kind}, {FIELDS}")
