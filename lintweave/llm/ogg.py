"""Operator 10: Ogg media columns.

Writing: the payload (UTF-8 bytes, filled with spaces to a positive multiple of 192) is 8-bit mono audio in packets of
up to 768 bytes, of four lacing values. Packets alternate between two logical streams, whose pages are interleaved; each
stream starts with a header packet, a page holds 255 lacing values, wherever that cuts a packet, and carries its granule
position (samples of the packets that end on it and before, -1 if none ends) and checksum. Reading: pages are found by their
capture pattern, their checksums verified, packets reassembled from lacing values (also across pages), streams
demultiplexed by serial number, and timestamps derived from granule positions.

The checksum is the unreflected CRC-32 of polynomial 0x04C11DB7; it is computed as the reflected one of bit-reversed
bytes. Null and empty texts give one packet of spaces. Equal texts give equal bytes. Damaged bytes raise ValueError.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import documents, id_text, slices

PACKET = 192
#: Bytes of a packet, but the last one.
PACKET_BYTES = 4 * PACKET
RATE = 8000
STREAMS = 2
#: Lacing values of a page.
PAGE_VALUES = 255
MAGIC = b"Samples8"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def checksum(page: bytes) -> int:
    """Of a page whose checksum field is zero."""
    reflected = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(reflected.to_bytes(4, "big").translate(_REVERSED), "little")


def _page(lacing: list[int], body: bytes, flags: int, granule: int, serial: int, number: int) -> bytes:
    page = struct.pack("<4sBBqIII", b"OggS", 0, flags, granule, serial, number, 0) + bytes([len(lacing), *lacing]) + body
    return page[:22] + struct.pack("<I", checksum(page)) + page[26:]


def pages(packets: list[bytes], serial: int, values: int = PAGE_VALUES) -> list[bytes]:
    """A logical stream's pages after its header page; the last says so."""
    lacing = [x for p in packets for x in (*[255] * (len(p) // 255), len(p) % 255)]
    body, out, at, ended, goes_on = b"".join(packets), [], 0, 0, False
    ends = np.concatenate([[0], np.cumsum([len(p) for p in packets], dtype=np.int64)])
    for k in range(0, max(1, len(lacing)), values):
        own = lacing[k : k + values]
        end, last, more = at + sum(own), k + values >= len(lacing), sum(x < 255 for x in own)
        out.append(_page(own, body[at:end], goes_on + 4 * last, int(ends[ended + more]) if more or last else -1, serial, k // values + 1))
        at, ended, goes_on = end, ended + more, bool(own) and own[-1] == 255
    return out


def write(payload: bytes) -> bytes:
    """The container's bytes for a payload of a multiple of PACKET bytes."""
    packets = [payload[i : i + PACKET_BYTES] for i in range(0, len(payload), PACKET_BYTES)]
    # all streams begin before any goes on
    out = [_page([len(MAGIC) + 6], MAGIC + struct.pack("<IBB", RATE, STREAMS, s), 2, 0, s + 1, 0) for s in range(STREAMS)]
    own = [pages(packets[s::STREAMS], s + 1) for s in range(STREAMS)]
    for k in range(max(map(len, own))):
        out += [x[k] for x in own if k < len(x)]
    return b"".join(out)


def read(data: bytes) -> tuple[bytes, dict[str, int]]:
    """The payload, and what the container says: pages, packets, streams, samples, and the end in microseconds."""
    packets: dict[int, list[bytes]] = {}
    open_packet: dict[int, bytes] = {}
    granules: dict[int, int] = {}
    numbers: dict[int, int] = {}
    at = pages = 0
    while at < len(data):
        if len(data) - at < 27:
            raise ValueError("a page is cut off")
        capture, version, flags, granule, serial, number, crc, n = struct.unpack_from("<4sBBqIIIB", data, at)
        if capture != b"OggS" or version:
            raise ValueError("no page where one is due")
        lacing = data[at + 27 : at + 27 + n]
        end = at + 27 + n + sum(lacing)
        page = data[at:end]
        if len(page) < end - at or checksum(page[:22] + b"\0\0\0\0" + page[26:]) != crc:
            raise ValueError("a page's checksum differs")
        if numbers.get(serial, -1) + 1 != number or bool(flags & 2) != (number == 0):
            raise ValueError("a page is missing")
        numbers[serial], pages, at = number, pages + 1, end
        place = 27 + n
        if bool(flags & 1) != (serial in open_packet):
            raise ValueError("a packet goes on where none is open, or isn't gone on with")
        held = open_packet.pop(serial, b"")
        done = packets.setdefault(serial, [])
        for size in lacing:
            held += page[place : place + size]
            place += size
            if size < 255:
                done.append(held)
                held = b""
        if n and lacing[-1] == 255:
            open_packet[serial] = held
        if granule >= 0:
            granules[serial] = granule
    if open_packet:
        raise ValueError("a packet has no end")
    order: dict[int, list[bytes]] = {}
    rate = RATE
    for found in packets.values():
        if not found or not found[0].startswith(MAGIC):
            raise ValueError("a stream has no header")
        rate, _, place = struct.unpack_from("<IBB", found[0], len(MAGIC))
        order[place] = found[1:]
    rows = [order[s] for s in sorted(order)]
    payload = b"".join(rows[i % len(rows)][i // len(rows)] for i in range(sum(map(len, rows))))
    samples = sum(granules.values())
    return payload, {"pages": pages, "packets": sum(map(len, rows)), "streams": len(rows), "samples": samples, "end_us": max(granules.values(), default=0) * 1_000_000 // rate}


def features(payload: bytes, facts: dict[str, int]) -> str:
    """The container's facts and simple measures of the samples, as text."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))
    measures = {"mean_milli": int(x.sum()) * 1000 // len(x), "energy": int((x * x).sum()) // len(x), "crossings": crossings, "peak": int(np.abs(x).max())}
    return ";".join(f"{k}={v}" for k, v in (facts | measures).items())


def media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media binary): each text's container; no shuffle."""

    def run(batches):
        for batch in batches:
            for part, texts in slices(batch):
                raw = [x.encode() for x in texts]
                made = [write(x + b" " * (PACKET * max(1, -(-len(x) // PACKET)) - len(x))) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(made, pa.binary())], ["doc_id", "n_bytes", "media"])

    source = id_text(docs, id_col, text_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def probe(containers: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) to digests of the payload as read back, digests of the container, and features."""

    def run(batches):
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part, rows = batch.slice(i, 256), []
                for data in part.column(2).to_pylist():
                    payload, facts = read(data)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), features(payload, facts)))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    kind = containers.schema["doc_id"].dataType.simpleString()
    return containers.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op10_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as Ogg and read back."""
    return probe(media(documents(spark, sf_dir)))
