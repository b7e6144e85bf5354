"""Ogg: pages with checksums, packets from lacing values, logical streams, timestamps.

A media column holds one physical Ogg bitstream in each row. Writing puts the
packets of several logical streams into pages; reading verifies every page's
checksum and sequence number, joins packets over page borders, separates the
streams by serial number and gives every packet its time from the granule
positions of the pages.

The text codec stores UTF-8 bytes, padded with byte 255, as unsigned 8-bit
samples: a stream of one header and one packet for every 576 samples, and beside
it an annotation stream with the length before padding.

Rows: null and empty texts give one packet of padding; any length is taken
whole; equal texts give equal media. A null media row has null in every column;
a damaged one raises OggError where it is read. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm.kernels import slices

FRAME, RATE = 576, 8000
_HEAD = struct.Struct("<4sBBqIIIB")
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
CONTINUED, FIRST, LAST = 1, 2, 4


class OggError(ValueError):
    """A bitstream that breaks the format."""


def checksum(page: bytes) -> int:
    """The page checksum: polynomial 0x04C11DB7, most significant bit first, from 0.

    It is the mirror image of the usual CRC-32: that of mirrored bytes, without
    its inversions, mirrored.
    """
    mirrored = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    whole = head + body
    return whole[:22] + checksum(whole).to_bytes(4, "little") + whole[26:]


def pages(serial: int, packets: list[tuple[bytes, int]]) -> list[bytes]:
    """One logical stream: packets with the granule position at their end, in pages of up to 255 lacing values."""
    out, lacing, body, granule, flags = [], bytearray(), [], -1, FIRST

    def flush(last: bool) -> None:
        nonlocal lacing, body, granule, flags
        out.append(_page(serial, len(out), flags | (LAST if last else 0), granule, bytes(lacing), b"".join(body)))
        lacing, body, granule, flags = bytearray(), [], -1, 0

    for i, (packet, at) in enumerate(packets):
        begin = 0
        while True:
            if len(lacing) == 255:
                flush(False)
                flags = CONTINUED if begin else 0
            room = 255 - len(lacing)
            left = len(packet) - begin
            if left // 255 + 1 <= room:
                lacing += b"\xff" * (left // 255) + bytes((left % 255,))
                body.append(packet[begin:])
                granule = at
                break
            lacing += b"\xff" * room
            body.append(packet[begin : begin + 255 * room])
            begin += 255 * room
        if i == 0 or i == len(packets) - 1:  # the header has a page of its own
            flush(i == len(packets) - 1)
    return out


@dataclass
class Stream:
    """A logical stream as read: packets, and the granule position of each that ends its page, else -1."""

    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    parts: list[bytes] = field(default_factory=list)
    number: int = 0
    ended: bool = False

    def times(self, rate: int) -> list[float]:
        """The time at which each packet ends. A page's granule position is that of the last packet that ends on it; those before it share the way from the page before evenly."""
        out, before, waiting = [], 0, 0
        for granule in self.granules:
            waiting += 1
            if granule >= 0:
                out += [(before + (granule - before) * (i + 1) / waiting) / rate for i in range(waiting)]
                before, waiting = granule, 0
        return out + [before / rate] * waiting


def read(media: bytes) -> dict[int, Stream]:
    """All logical streams by serial number; OggError if anything is amiss."""
    streams: dict[int, Stream] = {}
    at, view = 0, memoryview(media)
    while at < len(media):
        if len(media) - at < 27 or media[at : at + 4] != b"OggS":
            raise OggError(f"no page at byte {at}")
        _, version, flags, granule, serial, number, crc, count = _HEAD.unpack_from(media, at)
        lacing = media[at + 27 : at + 27 + count]
        start = at + 27 + count
        end = start + sum(lacing)
        if version or len(lacing) < count or end > len(media):
            raise OggError(f"bad page at byte {at}")
        if checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            raise OggError(f"bad checksum at byte {at}")
        if flags & FIRST:
            if serial in streams:
                raise OggError(f"stream {serial} begins twice")
            streams[serial] = Stream()
        s = streams.get(serial)
        if s is None or s.ended or number != s.number or bool(flags & CONTINUED) != bool(s.parts):
            raise OggError(f"page {number} of stream {serial} is out of place")
        s.number += 1
        size, first = 0, len(s.packets)
        for value in lacing:
            size += value
            if value < 255:
                s.parts.append(media[start : start + size])
                s.packets.append(s.parts[0] if len(s.parts) == 1 else b"".join(s.parts))
                s.granules.append(-1)
                s.parts.clear()
                start, size = start + size, 0
        if size:
            s.parts.append(media[start : start + size])
        if len(s.packets) > first:
            s.granules[-1] = granule
        s.ended = bool(flags & LAST)
        at = end
    if any(not s.ended or s.parts for s in streams.values()):
        raise OggError("a stream does not end")
    return streams


def pad(payload: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of a frame."""
    return payload + b"\xff" * (FRAME - len(payload) % FRAME if len(payload) % FRAME or not payload else 0)


def store(text: bytes) -> bytes:
    """Text bytes as an Ogg bitstream; its serial numbers follow from the bytes."""
    payload = pad(text)
    serial = zlib.crc32(payload)
    sound = [(b"U8PCM\0" + struct.pack("<IH", RATE, FRAME), 0)]
    sound += [(payload[i : i + FRAME], i + FRAME) for i in range(0, len(payload), FRAME)]
    note = [(b"NOTE\0", 0), (b"length=%d" % len(text), len(payload))]
    a, b = pages(serial, sound), pages(serial ^ 0x5A5A5A5A, note)
    return b"".join([a[0], b[0], *b[1:], *a[1:]])  # all first pages come before any other


def load(media: bytes) -> tuple[bytes, int, list[float]]:
    """The payload, its length before padding, and when each of its packets ends, in seconds."""
    payload = length = None
    times: list[float] = []
    for s in read(media).values():
        head, *rest = s.packets
        if head.startswith(b"U8PCM\0"):
            rate, _ = struct.unpack_from("<IH", head, 6)
            payload, times = b"".join(rest), s.times(rate)[1:]
        elif head == b"NOTE\0":
            length = int(rest[0].partition(b"=")[2])
    if payload is None or length is None:
        raise OggError("a stream is missing")
    return payload, length, times


def features(payload: bytes, times: list[float]) -> str:
    """How long it lasts, mean, root mean square about 128, zero crossings, and the loudest frame of the samples with the time at which it ends."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64)
    y = x - 128
    energy = (y * y).reshape(-1, FRAME).sum(axis=1)
    crossings = int(np.count_nonzero((y[1:] < 0) != (y[:-1] < 0)))
    loudest = int(energy.argmax())
    return f"seconds={times[-1]:.3f};mean={x.mean():.4f};rms={np.sqrt(energy.sum() / len(y)):.4f};crossings={crossings};loudest={loudest}@{times[loudest]:.3f}"


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id and media: every text as an Ogg bitstream."""

    def run(batches):
        for batch in slices(batches):
            media = [store(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def describe(media: DataFrame) -> DataFrame:
    """Lengths, digests and features of every media row, from the stored bytes."""
    names = "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature".split()
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def run(batches):
        for batch in batches:
            rows = []
            for m in batch.column("media"):
                if not m.is_valid:
                    rows.append((None,) * len(kinds))
                    continue
                raw = m.as_buffer().to_pybytes()
                payload, length, times = load(raw)
                rows.append((length, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(raw), hashlib.sha256(raw).hexdigest(), features(payload, times)))
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *cols], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
