"""Ogg containers in a binary column (operator 6): page checksums, packets from lacing values, logical streams, timestamps.

``read_ogg`` takes the bytes of any physical stream. A page whose checksum or length is wrong is counted and left out; reading goes
on at the next capture pattern. A packet that lost one of its pages is left out and its stream is marked as broken. Null bytes give
null; empty bytes give no streams. A page's granule position belongs to the last packet that ends on it; packets that end earlier
on the page, and pages on which none ends (position -1), have none. A timestamp is position / rate in seconds.

The query stores a payload as 8-bit samples in two logical streams which take turns block by block. Null text counts as empty.
Long texts are stored whole, in as many pages as they need. Equal texts give equal bytes, so repeated rows give equal results; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from .common import read_table, slices, unique_columns

CAPTURE = b"OggS"
HEADER = struct.Struct("<4sBBqIIIB")  # pattern, version, flags, granule position, serial, sequence, checksum, segments
CONTINUED, FIRST, LAST = 1, 2, 4
MIRRORED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))

#: The stored form: packets of so many samples, pages of so many lacing values, samples a second.
BLOCK, SEGMENTS, RATE = 16_384, 48, 8_000
#: First packet of each of its streams: name, rate, the stream's number, number of streams.
IDENT = struct.Struct("<8sIHH")
IDENT_NAME = b"smpl8bit"


def checksum(page: bytes) -> int:
    """Ogg's CRC has zlib's polynomial with the bits of bytes and result mirrored, and neither start nor end value."""
    crc = zlib.crc32(page.translate(MIRRORED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(MIRRORED), "big")


@dataclass
class Stream:
    serial: int
    packets: list[bytes] = field(default_factory=list)
    granules: list[int | None] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    broken: bool = False

    def seconds(self, rate: int) -> list[float | None]:
        return [None if g is None else g / rate for g in self.granules]


class StreamWriter:
    """Cuts the packets of one logical stream into pages."""

    def __init__(self, serial: int, segments: int = 255):
        self.serial, self.segments, self.sequence, self.flags = serial, segments, 0, FIRST

    def pages(self, packet: bytes, granule: int, last: bool = False) -> Iterator[bytes]:
        lacing = b"\xff" * (len(packet) // 255) + bytes([len(packet) % 255])
        for at in range(0, len(lacing), self.segments):
            values, ends = lacing[at : at + self.segments], at + self.segments >= len(lacing)
            head = [CAPTURE, 0, self.flags | LAST * (last and ends), granule if ends else -1, self.serial, self.sequence, 0, len(values)]
            page = HEADER.pack(*head) + values + packet[at * 255 : at * 255 + sum(values)]
            yield page[:22] + struct.pack("<I", checksum(page)) + page[26:]
            self.sequence, self.flags = self.sequence + 1, 0 if ends else CONTINUED
        self.flags = 0


def read_ogg(data: bytes | None) -> tuple[dict[int, Stream], int] | None:
    """The logical streams by serial number, and how many pages were damaged."""
    if data is None:
        return None
    streams: dict[int, Stream] = {}
    open_: dict[int, list[bytes] | None] = {}  # parts of a packet that goes on; None: its beginning is lost
    expected: dict[int, int] = {}
    damaged, at = 0, data.find(CAPTURE)
    while at >= 0:
        if len(data) - at < HEADER.size:
            damaged += 1
            break
        _, version, flags, granule, serial, sequence, crc, count = HEADER.unpack_from(data, at)
        lacing = data[at + HEADER.size : at + HEADER.size + count]
        begin = at + HEADER.size + count
        end = begin + sum(lacing)
        page = data[at:end]
        if version or len(lacing) < count or end > len(data) or checksum(page[:22] + bytes(4) + page[26:]) != crc:
            damaged += 1
            at = data.find(CAPTURE, at + 1)
            continue
        s = streams.setdefault(serial, Stream(serial))
        if sequence != expected.get(serial, 0 if flags & FIRST else sequence):
            s.broken, open_[serial] = True, None
        if not flags & CONTINUED:
            open_[serial] = []
        elif serial not in open_:
            s.broken, open_[serial] = True, None
        expected[serial] = sequence + 1
        s.pages, s.ended = s.pages + 1, bool(flags & LAST)
        done, size, pos = [], 0, begin
        for value in lacing:
            size += value
            if value < 255:
                parts = open_[serial]
                if parts is not None:
                    done.append(b"".join([*parts, data[pos : pos + size]]))
                pos, size, open_[serial] = pos + size, 0, []
        if size and open_[serial] is not None:
            open_[serial] = [*open_[serial], data[pos : pos + size]]
        s.packets += done
        s.granules += [None] * (len(done) - 1) + [granule if granule >= 0 else None] * bool(done)
        at = data.find(CAPTURE, end)
    return streams, damaged


def store(payload: bytes, streams: int = 2) -> bytes:
    """``payload`` as 8-bit samples, block by block in turn to each logical stream; all streams' first pages come first."""
    writers = [StreamWriter(k + 1, SEGMENTS) for k in range(streams)]
    blocks = [payload[a : a + BLOCK] for a in range(0, len(payload), BLOCK)]
    out = [p for k, w in enumerate(writers) for p in w.pages(IDENT.pack(IDENT_NAME, RATE, k, streams), 0, k >= len(blocks))]
    done = [0] * streams
    for k, block in enumerate(blocks):
        done[k % streams] += len(block)
        out += writers[k % streams].pages(block, done[k % streams], k + streams >= len(blocks))
    return b"".join(out)


def load(media: bytes) -> tuple[bytes, dict[str, float | int]]:
    """The payload, and features of it and of its container. Raises ValueError for bytes that ``store`` didn't make."""
    found, damaged = read_ogg(media)
    order, n, rate = {}, 0, RATE
    for serial, s in found.items():
        name, rate, k, n = IDENT.unpack(s.packets[0])
        if name != IDENT_NAME or s.broken:
            raise ValueError("not a stored payload")
        order[k] = found[serial]
    if damaged or len(order) != n:
        raise ValueError("damaged media")
    parts, at = [], 1
    while any(at < len(s.packets) for s in order.values()):
        parts += [order[k].packets[at] for k in range(n) if at < len(order[k].packets)]
        at += 1
    payload = b"".join(parts)
    samples = np.frombuffer(payload, np.uint8).astype(np.int16) - 128
    return payload, {
        "streams": n,
        "pages": sum(s.pages for s in order.values()),
        "packets": sum(len(s.packets) for s in order.values()),
        "ms": round(1000 * sum(s.seconds(rate)[-1] for s in order.values())),
        "peak": int(np.abs(samples).max(initial=0)),
        "crossings": int(np.count_nonzero((samples[1:] < 0) != (samples[:-1] < 0))),
    }


def _columns(rows: Iterable[tuple], names: list[str], types: list) -> pa.RecordBatch:
    rows = list(rows)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            rows = []
            for key, text in zip(keys[a:b], texts[a:b]):
                raw = (text or "").encode()
                rows.append((key, len(raw), store(raw + bytes(-len(raw) % 64 or (64 if not raw else 0)))))
            yield _columns(rows, ["doc_id", "n_bytes", "media"], [pa.int64(), pa.int64(), pa.binary()])


def _load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for batch in batches:
        rows = []
        for key, n, media in zip(*(c.to_pylist() for c in batch.columns)):
            payload, features = load(media)
            rows.append((key, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), ";".join(f"{k}={v}" for k, v in features.items())))
        yield _columns(rows, names, types)


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the stored form)."""
    return unique_columns(docs, ["doc_id", "text"]).mapInArrow(_store, "doc_id long, n_bytes long, media binary")


STREAMS = "damaged int, streams array<struct<serial:bigint,pages:int,packets:array<binary>,seconds:array<double>,ended:boolean,broken:boolean>>"


def streams(media: DataFrame, column: str = "media", rate: int = RATE) -> DataFrame:
    """All columns of ``media`` but that one (and but columns named damaged or streams), and per row: damaged (pages), streams
    array<struct<serial, pages, packets (bytes of each), seconds (of each), ended, broken>>; both null for null bytes."""
    rest = [c for c in media.columns if c not in (column, "damaged", "streams")]
    added = StructType.fromDDL(STREAMS)
    schema = StructType([*media.select(rest).schema.fields, *added.fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = batch.column(len(rest)).to_pylist()
            for a, b in slices(media):
                found = [read_ogg(x) for x in media[a:b]]
                damaged = pa.array([None if x is None else x[1] for x in found], pa.int32())
                rows = [None if x is None else [{"serial": s.serial, "pages": s.pages, "packets": s.packets, "seconds": s.seconds(rate), "ended": s.ended, "broken": s.broken} for s in x[0].values()] for x in found]
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns[: len(rest)], damaged, pa.array(rows, to_arrow_type(added["streams"].dataType))], [*rest, "damaged", "streams"])

    return media.select(*rest, column).mapInArrow(parse, schema)


def op6_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return to_media(read_table(spark, sf_dir, "documents")).mapInArrow(_load, schema)
