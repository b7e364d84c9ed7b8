"""Media columns: Ogg streams in binary columns.

A page carries a checksum, a lacing table that cuts its body into packets (a
packet ends at the first segment of under 255 bytes and may run on over pages),
the serial number of its logical stream and the granule position that its last
complete packet reaches.  :func:`demultiplex` verifies every checksum, puts
packets together per logical stream and turns granule positions into times.

:func:`from_text` stores a payload as unsigned 8-bit mono samples, one sample a
byte, beside a second logical stream that holds the unpadded length; pages of
both are interleaved as an encoder would write them.

Both are maps over rows: no shuffle, memory bounded by one row's media and one
Arrow batch.  Defined cases: a null or empty text is the payload of 64 zero
bytes; equal texts give equal media (serial numbers derive from the payload);
null media give null streams; broken media give the fault's description in
``fault`` and what was whole before it; repeated rows are kept; other columns
are ignored; an empty table gives no rows.
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

UNIT = 64
RATE = 8000
PACKET = 4000
PAGE_SEGMENTS = 255
HEAD = struct.Struct("<4sBBqIIIB")
SAMPLES, NOTES = b"PCM8", b"NOTE"

_REVERSED = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))


def page_checksum(page: bytes) -> int:
    """CRC-32 with polynomial 0x04c11db7, most significant bit first, start and final value 0.

    zlib's CRC is the same with all bits in reverse order and inverted ends.
    """
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


@dataclass
class Stream:
    """A logical stream: writer's and reader's state."""

    serial: int
    pages: int = 0
    packets: list[bytes] = field(default_factory=list)
    granules: list[int] = field(default_factory=list)
    begun: bool = False
    ended: bool = False
    part: bytearray = field(default_factory=bytearray)


def write_page(s: Stream, segments: list[int], body: bytes, granule: int, flags: int) -> bytes:
    """flags: 1 continues a packet, 2 begins the stream, 4 ends it."""
    head = HEAD.pack(b"OggS", 0, flags, granule, s.serial, s.pages, 0, len(segments)) + bytes(segments)
    crc = page_checksum(head + body)
    s.pages += 1
    return head[:22] + crc.to_bytes(4, "little") + head[26:] + body


def write_packets(s: Stream, packets: list[tuple[bytes, int]], last: bool) -> list[bytes]:
    """Pages of packets with the granule position that each reaches."""
    pages: list[bytes] = []
    segments: list[int] = []
    body = bytearray()
    granule, continues = -1, False
    for k, (packet, reached) in enumerate(packets):
        lacing = [255] * (len(packet) // 255) + [len(packet) % 255]
        at = 0
        while lacing:
            take = lacing[: PAGE_SEGMENTS - len(segments)]
            lacing = lacing[len(take) :]
            n = sum(take)
            segments += take
            body += packet[at : at + n]
            at += n
            if not lacing:
                granule = reached
            if len(segments) == PAGE_SEGMENTS:
                end = 4 if last and not lacing and k == len(packets) - 1 else 0
                pages.append(write_page(s, segments, bytes(body), granule, continues | end))
                segments, body, granule, continues = [], bytearray(), -1, bool(lacing)
    if segments:
        pages.append(write_page(s, segments, bytes(body), granule, continues | (4 if last else 0)))
    return pages


def write(payload: bytes, n_bytes: int) -> bytes:
    """Two logical streams: the samples, and a note of the unpadded length."""
    serial = zlib.crc32(payload, n_bytes & 0xFFFFFFFF)
    sound, notes = Stream(serial), Stream(serial ^ 0xFFFFFFFF)
    first = [
        *[write_page(sound, [len(h)], h, 0, 2) for h in [SAMPLES + struct.pack("<BBI", 1, 8, RATE)]],
        *[write_page(notes, [len(h)], h, 0, 2) for h in [NOTES + struct.pack("<B", 1)]],
    ]
    parts = [
        (payload[i : i + PACKET], min(i + PACKET, len(payload))) for i in range(0, len(payload), PACKET)
    ]
    noted = write_packets(notes, [(struct.pack("<Q", n_bytes), len(payload))], True)
    pages = write_packets(sound, parts, True)
    return b"".join([*first, *pages[:1], *noted, *pages[1:]])


def demultiplex(media: bytes) -> tuple[dict[int, Stream], str]:
    """Logical streams by serial number; what is wrong, or an empty string."""
    streams: dict[int, Stream] = {}
    at, size = 0, len(media)
    while at < size:
        if size - at < HEAD.size or media[at : at + 4] != b"OggS":
            return streams, f"no page at byte {at}"
        _, version, flags, granule, serial, number, crc, n = HEAD.unpack_from(media, at)
        lacing = media[at + HEAD.size : at + HEAD.size + n]
        end = at + HEAD.size + n + sum(lacing)
        if version or len(lacing) < n or end > size:
            return streams, f"cut or unknown page at byte {at}"
        page = media[at:end]
        if page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            return streams, f"wrong checksum at byte {at}"
        s = streams.setdefault(serial, Stream(serial))
        if number != s.pages or bool(flags & 2) == s.begun or s.ended or bool(flags & 1) != bool(s.part):
            return streams, f"page out of order at byte {at}"
        s.begun, s.ended, s.pages = True, bool(flags & 4), s.pages + 1
        body, done = HEAD.size + n, 0
        # A packet ends with each segment of under 255 bytes.
        cuts = [i for i, x in enumerate(lacing) if x < 255]
        begin = 0
        for i in cuts:
            take = sum(lacing[begin : i + 1])
            s.packets.append(bytes(s.part) + page[body : body + take])
            s.part.clear()
            body, begin, done = body + take, i + 1, done + 1
        s.part += page[body:]
        s.granules += [-1] * (done - 1) + [granule] if done else []
        at = end
    bad = [k for k, s in streams.items() if not s.ended or s.part]
    return streams, f"streams without an end: {len(bad)}" if bad else ""


def payload_of(text: bytes) -> bytes:
    return text + bytes(-len(text) % UNIT if text else UNIT)


def from_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, ``n_bytes`` and ``media`` of each row."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                raw = [(t or "").encode() for t in part.column(1).to_pylist()]
                media = [write(payload_of(t), len(t)) for t in raw]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())],
                    ["key", "n_bytes", "media"],
                )

    given = df.select(F.col(id_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "key long, n_bytes long, media binary").withColumnRenamed("key", id_col)


def samples_of(media: bytes) -> tuple[bytes, int, dict[int, Stream], str]:
    streams, fault = demultiplex(media)
    sound = next((s for s in streams.values() if s.packets and s.packets[0][:4] == SAMPLES), None)
    notes = next((s for s in streams.values() if s.packets and s.packets[0][:4] == NOTES), None)
    n = struct.unpack("<Q", notes.packets[1])[0] if notes and len(notes.packets) > 1 else -1
    return b"".join(sound.packets[1:]) if sound else b"", n, streams, fault


def feature_of(payload: bytes, streams: dict[int, Stream]) -> str:
    """Pages, packets and length of the streams, and mean, power and sign changes of the samples."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    reached = max((g for s in streams.values() for g in s.granules), default=0)
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams.values())};"
        f"packets={sum(len(s.packets) for s in streams.values())};ms={reached * 1000 // RATE};"
        f"sum={int(x.sum())};power={int((x * x).sum())};crossings={crossings}"
    )


def read(df: DataFrame, media_col: str = "media", id_col: str = "doc_id") -> DataFrame:
    """One row per media: ``payload``, ``n_bytes``, ``feature``, ``streams`` and ``fault``.

    ``streams`` has of each logical stream its serial number, codec, pages,
    packets, last granule position and seconds.
    """
    stream = "struct<serial:long,codec:string,pages:long,packets:long,granule:long,seconds:double>"
    kinds = pa.list_(
        pa.struct(
            [("serial", pa.int64()), ("codec", pa.string()), ("pages", pa.int64()), ("packets", pa.int64())]
            + [("granule", pa.int64()), ("seconds", pa.float64())]
        )
    )

    def run(batches):
        for batch in batches:
            rows = []
            for key, media in zip(batch.column(0).to_pylist(), batch.column(1)):
                if not media.is_valid:
                    rows.append((key, None, None, None, None, None))
                    continue
                payload, n, streams, fault = samples_of(media.as_py())
                told = [
                    {
                        "serial": s.serial,
                        "codec": s.packets[0][:4].decode("latin-1") if s.packets else None,
                        "pages": s.pages,
                        "packets": len(s.packets),
                        "granule": max(s.granules, default=-1),
                        "seconds": max(s.granules, default=0) / RATE,
                    }
                    for s in streams.values()
                ]
                rows.append((key, payload, n, feature_of(payload, streams), told, fault))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([r[i] for r in rows], kind)
                    for i, kind in enumerate([pa.int64(), pa.binary(), pa.int64(), pa.string(), kinds, pa.string()])
                ],
                ["key", "payload", "n_bytes", "feature", "streams", "fault"],
            )

    given = df.select(F.col(id_col).cast("long").alias("key"), F.col(media_col).alias("media"))
    schema = f"key long, payload binary, n_bytes long, feature string, streams array<{stream}>, fault string"
    return given.mapInArrow(run, schema).withColumnRenamed("key", id_col)


def digest(df: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digests of the media of :func:`from_text` and of the payload read back from them."""

    def run(batches):
        sha = hashlib.sha256
        for batch in batches:
            rows = []
            for key, given, media in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                stored = media.as_py()
                payload, n, streams, fault = samples_of(stored)
                if fault or n != given:
                    raise ValueError(f"media of {key}: {fault or 'wrong length'}")
                rows.append(
                    (key, n, len(payload), sha(payload).hexdigest(), zlib.crc32(payload[-UNIT:]))
                    + (len(stored), sha(stored).hexdigest(), feature_of(payload, streams))
                )
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)

    names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = "key long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
    given = df.select(F.col(id_col).cast("long").alias("key"), "n_bytes", "media")
    return given.mapInArrow(run, kinds + "media_sha256 string, feature string").withColumnRenamed("key", id_col)
