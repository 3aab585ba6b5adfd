"""Media columns: texts as 8-bit samples in Ogg.

A stream of pages carries two logical streams; packets of samples go to them in turn. Reading
verifies each page's checksum, reassembles packets from lacing values, parts the streams by
serial number and takes times from granule positions.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textops import slices

RATE = 8000
PACKET = 4096
SERIALS = (1, 2)
_MIRROR = bytes(int(f"{b:08b}"[::-1], 2) for b in range(256))
_HEAD = struct.Struct("<4sBBqIIIB")
_INTRO = struct.Struct("<8sIIII")
_MAGIC = b"PCM8\0\0\0\1"


def page_checksum(page: bytes) -> int:
    """Ogg's CRC-32: polynomial 0x04C11DB7 from the high bit, from 0, nothing inverted.

    zlib's runs the same polynomial from the low bit, so it takes mirrored bytes and gives a mirrored value.
    """
    low = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(low.to_bytes(4, "little").translate(_MIRROR), "big")


def write_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEAD.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    page = head + body
    return page[:22] + struct.pack("<I", page_checksum(page)) + page[26:]


def _laces(size: int) -> bytes:
    return b"\xff" * (size // 255) + bytes([size % 255])


def write_ogg(payload: bytes, n_bytes: int, rate: int = RATE, packet: int = PACKET) -> bytes:
    """The payload in two logical streams, a packet to each in turn; a granule is a sample of the stream."""
    packets: dict[int, list[bytes]] = {s: [_INTRO.pack(_MAGIC, rate, packet, len(payload), n_bytes)] for s in SERIALS}
    for i in range(0, len(payload), packet):
        packets[SERIALS[i // packet % 2]].append(payload[i : i + packet])
    out, pages = [], []
    for s in SERIALS:
        out.append(write_page(s, 0, 2, 0, _laces(len(packets[s][0])), packets[s][0]))
        number, granule, lacing, body = 1, 0, b"", []
        own = packets[s][1:] or [b""]
        for k, data in enumerate(own):
            laces, at, carried = _laces(len(data)), 0, False
            while laces:
                room = 255 - len(lacing)
                part, laces = laces[:room], laces[room:]
                taken = sum(part)
                lacing += part
                body.append(data[at : at + taken])
                at += taken
                if not laces:
                    granule += len(data)
                last = not laces and k == len(own) - 1
                if len(lacing) == 255 or last:
                    ends = any(x < 255 for x in lacing)
                    pages.append((granule, s, number, write_page(s, number, carried | 4 * last, granule if ends else -1, lacing, b"".join(body))))
                    number, lacing, body = number + 1, b"", []
                    carried = bool(laces)
    pages.sort(key=lambda p: (p[2], p[1]))  # the streams' pages alternate
    return b"".join([*out, *[p[3] for p in pages]])


@dataclass
class Stream:
    packets: list[bytes] = field(default_factory=list)
    granule: int = 0
    #: The granule position of each page that has one: the samples up to the end of its last whole packet.
    granules: list[int] = field(default_factory=list)
    pages: int = 0
    ended: bool = False
    open: bytes | None = None


def read_ogg(data: bytes) -> dict[int, Stream]:
    """Logical streams by serial number; raises ValueError where a page is damaged, missing or out of order."""
    streams: dict[int, Stream] = {}
    at = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("a page is cut off")
        magic, version, flags, granule, serial, number, checksum, n = _HEAD.unpack_from(data, at)
        lacing = data[at + 27 : at + 27 + n]
        body = at + 27 + n
        end = body + sum(lacing)
        if magic != b"OggS" or version or end > len(data):
            raise ValueError("no page")
        if page_checksum(data[at : at + 22] + b"\0\0\0\0" + data[at + 26 : end]) != checksum:
            raise ValueError("a page's checksum differs")
        if (serial not in streams) != bool(flags & 2):
            raise ValueError("a stream does not begin with its first page")
        stream = streams.setdefault(serial, Stream())
        if stream.ended or number != stream.pages or bool(flags & 1) != (stream.open is not None):
            raise ValueError("a page is missing")
        run = 0
        for lace in lacing:
            run += lace
            if lace < 255:
                stream.packets.append((stream.open or b"") + data[body : body + run])
                body, run, stream.open = body + run, 0, None
        if run:
            stream.open = (stream.open or b"") + data[body : body + run]
        stream.pages += 1
        stream.ended = bool(flags & 4)
        if granule >= 0:
            if granule < stream.granule:
                raise ValueError("a granule position goes back")
            stream.granule = granule
            stream.granules.append(granule)
        at = end
    if any(not s.ended or s.open is not None for s in streams.values()):
        raise ValueError("a stream does not end")
    return streams


def join_streams(streams: dict[int, Stream]) -> tuple[bytes, dict]:
    """The payload, and what its headers and granules say."""
    order = sorted(streams)
    intro = [_INTRO.unpack(streams[s].packets[0]) for s in order]
    if any(x != intro[0] or x[0] != _MAGIC for x in intro):
        raise ValueError("the streams' headers differ")
    _, rate, packet, size, n_bytes = intro[0]
    parts = [b""] * max(1, -(-size // packet))
    for k, s in enumerate(order):
        for i, data in enumerate(streams[s].packets[1:]):
            if i * len(order) + k < len(parts):
                parts[i * len(order) + k] = data
    seconds = [streams[s].granule / rate for s in order]
    times = [[g / rate for g in streams[s].granules[1:]] for s in order]  # the first page of a stream is its header
    payload = b"".join(parts)
    if len(payload) != size or sum(streams[s].granule for s in order) != size:
        raise ValueError("the payload's length differs")
    return payload, {"rate": rate, "n_bytes": n_bytes, "pages": sum(x.pages for x in streams.values()), "packets": sum(len(x.packets) for x in streams.values()), "seconds": seconds, "times": times}


def features(payload: bytes, said: dict) -> str:
    """Sample statistics, and the streams' durations and the times at which their pages end, as text."""
    x = np.frombuffer(payload, np.uint8)
    level = x.astype(np.float64) - 128
    crossings = int(((x[1:] >= 128) != (x[:-1] >= 128)).sum())
    times = "+".join(f"{s:.6f}" for s in said["seconds"])
    ends = "+".join("/".join(f"{t:.6f}" for t in own) for own in said["times"])
    return f"rate={said['rate']};pages={said['pages']};packets={said['packets']};seconds={times};ends={ends};peak={int(np.abs(level).max())};mean={x.mean():.4f};rms={np.sqrt((level * level).mean()):.4f};crossings={crossings}"


def encode_ogg(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and media (binary) for every row: the text's UTF-8 bytes, with bytes 0 up to a positive multiple of 64.

    Null counts as empty; equal texts have equal media; a very long text makes many pages. Repeated rows and null ids keep a row each,
    other columns are left out, and an empty table gives an empty one.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            media = []
            for t in batch.column(1).to_pylist():
                raw = (t or "").encode()
                media.append(write_ogg(raw + bytes(-len(raw) % 64 if raw else 64), len(raw)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(write, "doc_id long, media binary")


def decode_ogg(stored: DataFrame) -> DataFrame:
    """(doc_id, media) -> doc_id, n_bytes, payload, media, feature and problem, read from the stored bytes.

    Null media give nulls, and so do damaged ones, whose problem says why. Repeated rows keep a row each.
    """
    names = ["doc_id", "n_bytes", "payload", "media", "feature", "problem"]

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            rows: list[list] = [[], [], [], []]
            for media in batch.column(1).to_pylist():
                values: tuple = (None, None, None, None)
                if media is not None:
                    try:
                        payload, said = join_streams(read_ogg(media))
                        values = (said["n_bytes"], payload, features(payload, said), None)
                    except (ValueError, IndexError, struct.error) as e:  # damaged, or another maker's
                        values = (None, None, None, str(e) or "not of this form")
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.binary()), batch.column(1), pa.array(rows[2], pa.string()), pa.array(rows[3], pa.string())], names)

    return stored.select("doc_id", "media").mapInArrow(read, "doc_id long, n_bytes long, payload binary, media binary, feature string, problem string")


def op5(docs: DataFrame) -> DataFrame:
    size = F.octet_length("payload")
    return decode_ogg(encode_ogg(docs)).select(
        "doc_id",
        F.coalesce("n_bytes", F.raise_error(F.concat(F.lit("a medium of this job is damaged: "), F.col("problem")))).alias("n_bytes"),
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), size - 63, F.lit(64))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def brute_force(rows: list[tuple[int, str | None]]) -> list[tuple]:
    """What op5 returns but for the media and feature columns."""
    out = []
    for doc, text in rows:
        raw = (text or "").encode()
        payload = raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")
        out.append((doc, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])))
    return out
