"""Media columns in Ogg: multiplexing, page checksums, lacing, logical streams and granule times.

`encode` turns a text or binary column into Ogg physical streams, `packets` reads any Ogg column into one row
a packet, and `digest` reads a column that `encode` made and describes it. A stored payload is two logical
streams: 8-bit samples in packets of PACKET bytes, and a stream of checks with the CRC-32 of each sample packet.

Cases: null media gives no packets; an empty text is stored as 64 zero samples; a page whose checksum fails is
skipped and counted in `bad_pages`, and a packet that has lost a page is dropped and counted in `holes`; bytes
between pages are skipped until the next capture pattern. Repeated rows give repeated results. Other columns of
the input aren't read, so their names don't matter.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sha256_hex, text_blocks, utf8

RATE, PACKET, UNIT = 8000, 4096, 64
SAMPLES, CHECKS = 1, 2
#: Fixed values of the format: the capture pattern, header flags and the page header's layout.
CAPTURE, CONTINUED, FIRST, LAST = b"OggS", 1, 2, 4
HEADER = struct.Struct("<4sBBqIIIB")
#: Segments a page holds at most here (the format allows 255); packets of over 64 segments span pages.
PAGE_SEGMENTS = 64
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def page_crc(data: bytes) -> int:
    """The format's CRC (0x04C11DB7, most significant bit first, from 0), by way of zlib's bit-reversed one."""
    x = zlib.crc32(data.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(x.to_bytes(4, "big").translate(_REVERSED), "little")


@dataclass
class Page:
    flags: int
    granule: int
    serial: int
    number: int
    lacing: bytes
    body: bytes

    def pack(self) -> bytes:
        head = HEADER.pack(CAPTURE, 0, self.flags, self.granule, self.serial, self.number, 0, len(self.lacing))
        raw = head + self.lacing + self.body
        return raw[:22] + struct.pack("<I", page_crc(raw)) + raw[26:]


@dataclass
class Stream:
    """A logical stream as read: its packets with the granule position at each one's end (-1: not known)."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    holes: int = 0
    ended: bool = False
    part: bytes | None = None
    next_page: int = 0


def paginate(serial: int, packets: list[tuple[bytes, int]], segments: int = PAGE_SEGMENTS) -> Iterator[tuple[int, Page]]:
    """Pages of a logical stream, each with the granule position by which it has to be in the physical stream."""
    lacing, body, number, granule, flags = bytearray(), bytearray(), 0, -1, FIRST
    for i, (data, at) in enumerate(packets):
        values = bytes([255]) * (len(data) // 255) + bytes([len(data) % 255])
        done = 0
        while done < len(values):
            if len(lacing) == segments or (i == 1 and number == 0):  # the first packet has a page of its own
                yield at, Page(flags, granule, serial, number, bytes(lacing), bytes(body))
                flags, number, granule = CONTINUED if done else 0, number + 1, -1
                lacing.clear(), body.clear()
            take = values[done : done + segments - len(lacing)]
            start = done * 255
            body += data[start : start + sum(take)]
            lacing += take
            done += len(take)
        granule = at
    yield packets[-1][1], Page(flags | LAST, granule, serial, number, bytes(lacing), bytes(body))


def mux(streams: dict[int, list[tuple[bytes, int]]]) -> bytes:
    """One physical stream: all first pages, then the others by time."""
    pages = [(not p.flags & FIRST, at, serial, p.number, p) for serial, packets in streams.items() for at, p in paginate(serial, packets)]
    return b"".join(p.pack() for *_, p in sorted(pages, key=lambda x: x[:4]))


def pages(data: bytes) -> Iterator[Page | None]:
    """The pages found; None for one whose checksum fails or that is cut short."""
    at = data.find(CAPTURE)
    while at >= 0:
        if len(data) < at + 27:
            yield None
            return
        _, version, flags, granule, serial, number, crc, n = HEADER.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        raw = data[at:end]
        if version or len(lacing) < n or len(data) < end or page_crc(raw[:22] + bytes(4) + raw[26:]) != crc:
            yield None
            at = data.find(CAPTURE, at + 4)
            continue
        yield Page(flags, granule, serial, number, lacing, raw[27 + n :])
        at = data.find(CAPTURE, end)


def demux(data: bytes) -> tuple[dict[int, Stream], int]:
    """Logical streams by serial number, and the number of bad pages."""
    streams: dict[int, Stream] = {}
    bad = 0
    for page in pages(data):
        if page is None:
            bad += 1
            continue
        s = streams.setdefault(page.serial, Stream())
        lost = page.number != s.next_page
        if lost or (s.part is not None) != bool(page.flags & CONTINUED):
            s.holes += 1
            s.part = None
        s.pages, s.next_page, s.ended = s.pages + 1, page.number + 1, bool(page.flags & LAST)
        skip = bool(page.flags & CONTINUED) and s.part is None  # the rest of a packet whose start is lost
        part, at, ends = s.part or b"", 0, []
        for i, n in enumerate(page.lacing):
            if n == 255:
                continue
            ends.append(i)
        i = 0
        for e in ends:
            n = sum(page.lacing[i : e + 1])
            if skip:
                skip = False
            else:
                s.packets.append(part + page.body[at : at + n])
                s.granules.append(-1)
            part, at, i = b"", at + n, e + 1
        if ends and s.granules:
            s.granules[-1] = page.granule
        s.part = None if i == len(page.lacing) or skip else part + page.body[at:]
    for s in streams.values():
        s.holes += s.part is not None
    return streams, bad


def end_times(stream: Stream, rate: int = RATE) -> list[float | None]:
    """Seconds at the end of each packet. A page states the position of the last packet that ends on it; those
    before it are placed by their samples, counted back from there."""
    out: list[float | None] = [None] * len(stream.packets)
    at = None
    for i in range(len(out) - 1, -1, -1):
        at = stream.granules[i] if stream.granules[i] >= 0 else at
        out[i] = None if at is None else at / rate
        at = None if at is None else max(0, at - len(stream.packets[i]))
    return out


def store(payload: bytes) -> bytes:
    """The payload as a stream of samples and a stream of checks."""
    parts = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    ends = [min((i + 1) * PACKET, len(payload)) for i in range(len(parts))]
    head = (struct.pack("<4sIq", b"PCM8", RATE, len(payload)), 0)
    checks = [(struct.pack("<I", zlib.crc32(p)), e) for p, e in zip(parts, ends, strict=True)]
    return mux({SAMPLES: [head, *zip(parts, ends, strict=True)], CHECKS: [(b"CRC1", 0), *checks]})


def load(media: bytes) -> tuple[bytes, dict[int, Stream], int, int]:
    """Payload, streams, bad pages and failed checks."""
    streams, bad = demux(media)
    samples, checks = streams.get(SAMPLES, Stream()), streams.get(CHECKS, Stream())
    parts = samples.packets[1:]
    wrong = sum(zlib.crc32(p) != int.from_bytes(c, "little") for p, c in zip(parts, checks.packets[1:], strict=False))
    return b"".join(parts), streams, bad, wrong + abs(len(parts) - len(checks.packets[1:]))


def padded(text: bytes) -> bytes:
    return text + bytes(UNIT - len(text) if not text else -len(text) % UNIT)


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_bytes, media): each row's UTF-8, padded with 0 to a positive multiple of 64, as an Ogg stream."""
    schema = f"`{key}` {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary"

    def run(batches):
        for block in text_blocks(batches, text):
            raw = utf8(block, text)
            yield pa.RecordBatch.from_arrays([block.column(0), pa.array(map(len, raw), pa.int64()), pa.array((store(padded(x)) for x in raw), pa.binary())], [key, "n_bytes", "media"])

    return docs.select(key, text).mapInArrow(run, schema)


def packets(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row a packet of any Ogg column: serial, packet_no, n_bytes, end_s (null: not stated), data."""
    names = [key, "serial", "packet_no", "n_bytes", "end_s", "data"]
    schema = f"`{key}` {media.schema[key].dataType.simpleString()}, serial long, packet_no long, n_bytes long, end_s double, data binary"

    def run(batches):
        for block in text_blocks(batches, column):
            rows = []
            for k, raw in zip(block.column(0).to_pylist(), block.column(1).to_pylist(), strict=True):
                for serial, s in sorted(demux(raw or b"")[0].items()):
                    rows += [(k, serial, i, len(p), t, p) for i, (p, t) in enumerate(zip(s.packets, end_times(s), strict=True))]
            if rows:
                kinds = [block.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.select(key, column).mapInArrow(run, schema)


def digest(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """What `encode` stored, read back: checksums and a feature string of streams, times and sample statistics."""
    names = [key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "bad_pages", "seconds"]
    schema = f"`{key}` {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bad_pages long, seconds double"

    def one(raw: bytes) -> tuple:
        payload, streams, bad, wrong = load(raw)
        s = streams.get(SAMPLES, Stream())
        times = end_times(s)
        x = np.frombuffer(payload, np.uint8).astype(np.int64)
        crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
        seconds = times[-1] if times and times[-1] is not None else 0.0
        feature = f"streams={len(streams)};pages={sum(v.pages for v in streams.values())};packets={len(s.packets)};bad={bad};holes={sum(v.holes for v in streams.values())};wrong={wrong};ended={int(s.ended)};ms={round(seconds * 1000)};peak={int(x.max(initial=0))};sum={int(x.sum())};energy={int((x * x).sum())};crossings={crossings}"
        return len(payload), sha256_hex(payload), zlib.crc32(payload[-UNIT:]), len(raw), sha256_hex(raw), feature, bad, seconds

    def run(batches):
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64()]
        for block in text_blocks(batches, "media"):
            rows = [one(raw or b"") for raw in block.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([block.column(0), block.column(1), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)
