"""Text payloads in MPEG transport streams: multiplex, read back, features.

A payload is padded with blanks to a positive multiple of 192 bytes and carried in one elementary
stream (private data) of one program: PAT, PMT, then packetized elementary packets of up to 16
frames of 192 bytes, each with a presentation timestamp; the first transport packet of every
eighth one is a random-access point. The reader knows nothing of the writer's layout: it parses
the program tables (with their CRC), checks continuity counters, reassembles the elementary
packets and lists timestamps and random-access points.

Nulls: a null text is the empty text (192 blanks are stored); a null id stays null. Repeated rows
are stored each. Other input columns are ignored. A broken stream raises ValueError.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, text_or_empty

FRAME = 192
FRAMES = 16  # of an elementary packet at most
TICKS = 3600  # of a 90 kHz clock, for each frame
FIRST_PTS = 126_000
RANDOM_ACCESS = 8  # every so many elementary packets
PMT_PID, DATA_PID, PROGRAM = 0x100, 0x101, 1
PRIVATE_DATA, PRIVATE_STREAM = 0x06, 0xBD
PACKET = 188
HEADER = 14  # bytes of an elementary packet's header with a timestamp
FIRST_ROOM, ROOM = 176, 184


@lru_cache(256)
def crc_mpeg(data: bytes) -> int:
    """CRC-32/MPEG-2."""
    crc = 0xFFFFFFFF
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def _section(table_id: int, ident: int, body: bytes) -> bytes:
    rest = ident.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    data = bytes([table_id]) + (0xB000 | len(rest) + 4).to_bytes(2, "big") + rest
    return data + crc_mpeg(data).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    return (bytes([0x47, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0]) + section).ljust(PACKET, b"\xff")


@lru_cache(1)
def _tables() -> bytes:
    pat = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return _table_packet(0, pat) + _table_packet(PMT_PID, pmt)


def pad(data: bytes) -> bytes:
    """Blanks up to a positive multiple of 192 bytes."""
    return data.ljust(max(FRAME, -(-len(data) // FRAME) * FRAME), b" ")


def _elementary(chunk: np.ndarray, first: int, counter: int) -> np.ndarray:
    """Transport packets of elementary packets of equal size; chunk: one row each; first: index of the first."""
    n, size = chunk.shape
    total = HEADER + size
    after = max(0, total - FIRST_ROOM)
    full, tail = divmod(after, ROOM)
    count = 1 + full + bool(tail)
    index = np.arange(first, first + n, dtype=np.int64)
    pts = (FIRST_PTS + index * FRAMES * TICKS) & ((1 << 33) - 1)
    pes = np.empty((n, total), np.uint8)
    pes[:, :9] = np.frombuffer(bytes([0, 0, 1, PRIVATE_STREAM]) + (size + 8).to_bytes(2, "big") + b"\x84\x80\x05", np.uint8)
    for k, byte in enumerate((0x21 | (pts >> 30) << 1, pts >> 22, pts >> 14 | 1, pts >> 7, pts << 1 | 1)):
        pes[:, 9 + k] = byte & 0xFF
    pes[:, HEADER:] = chunk
    out = np.full((n, count, PACKET), 0xFF, np.uint8)
    out[:, :, 0] = 0x47
    out[:, :, 1] = DATA_PID >> 8
    out[:, 0, 1] |= 0x40
    out[:, :, 2] = DATA_PID & 0xFF
    out[:, :, 3] = 0x10 | (counter + np.arange(n * count).reshape(n, count)) & 15
    lead = min(FIRST_ROOM, total)
    out[:, 0, 3] |= 0x20
    out[:, 0, 4] = PACKET - 5 - lead
    out[:, 0, 5] = 0x10 | np.where(index % RANDOM_ACCESS == 0, 0x40, 0)
    clock = np.maximum(pts - TICKS, 0)
    for k, byte in enumerate((clock >> 25, clock >> 17, clock >> 9, clock >> 1, (clock & 1) << 7 | 0x7E, clock * 0)):
        out[:, 0, 6 + k] = byte & 0xFF
    out[:, 0, PACKET - lead :] = pes[:, :lead]
    if full:
        out[:, 1 : 1 + full, 4:] = pes[:, lead : lead + full * ROOM].reshape(n, full, ROOM)
    if tail:
        out[:, -1, 3] |= 0x20
        out[:, -1, 4] = ROOM - tail - 1
        if ROOM - tail > 1:
            out[:, -1, 5] = 0
        out[:, -1, PACKET - tail :] = pes[:, total - tail :]
    return out.reshape(-1)


def multiplex(payload: bytes) -> bytes:
    """The transport stream of a padded payload."""
    if not payload or len(payload) % FRAME:
        raise ValueError("the payload is no positive multiple of 192 bytes")
    data, size = np.frombuffer(payload, np.uint8), FRAME * FRAMES
    n = len(data) // size
    parts, counter = [_tables()], 0
    if n:
        packets = _elementary(data[: n * size].reshape(n, size), 0, 0)
        counter = len(packets) // PACKET
        parts.append(packets.tobytes())
    if len(data) > n * size:
        parts.append(_elementary(data[n * size :].reshape(1, -1), n, counter).tobytes())
    return b"".join(parts)


def _payload(packet: bytes) -> bytes:
    """What a transport packet carries besides its header and adaptation field."""
    return packet[5 + packet[4] :] if packet[3] & 0x20 else packet[4:]


def _section_body(packets: tuple[bytes, ...], table_id: int) -> bytes:
    """Body of the first section in a PID's packets, which may run over several, after a check of its CRC."""
    start = next((k for k, p in enumerate(packets) if p[1] & 0x40), None)
    if start is None:
        raise ValueError("a program table is missing")
    data = _payload(packets[start])
    data = data[1 + data[0] :] if data else b""
    for p in packets[start + 1 :]:
        if len(data) >= 3 and len(data) >= 3 + (int.from_bytes(data[1:3], "big") & 0xFFF) or p[1] & 0x40:
            break
        data += _payload(p)
    section = data[: 3 + (int.from_bytes(data[1:3], "big") & 0xFFF)]
    if len(section) < 12 or section[0] != table_id or crc_mpeg(section[:-4]) != int.from_bytes(section[-4:], "big"):
        raise ValueError("a program table is broken")
    return section[8:-4]


@lru_cache(64)
def _data_stream(pat: tuple[bytes, ...]) -> int:
    """PID of the first program's table."""
    body = _section_body(pat, 0x00)
    for at in range(0, len(body) - 3, 4):
        if body[at : at + 2] != b"\0\0":  # number 0 is the network's table
            return int.from_bytes(body[at + 2 : at + 4], "big") & 0x1FFF
    raise ValueError("the stream has no program")


@lru_cache(64)
def _elementary_stream(pmt: tuple[bytes, ...]) -> tuple[int, int]:
    """Type and PID of the program's first stream."""
    body = _section_body(pmt, 0x02)
    at = 4 + (int.from_bytes(body[2:4], "big") & 0xFFF)
    if at + 5 > len(body):
        raise ValueError("the program has no stream")
    return body[at], int.from_bytes(body[at + 1 : at + 3], "big") & 0x1FFF


def demultiplex(media: bytes) -> dict:
    """payload, timestamps (90 kHz), random_access (packet numbers), continuity_errors, stream_type, pid and packets of a stream.

    A packet sent twice in a row counts once; a counter may jump where the packet says so.
    """
    if not media or len(media) % PACKET:
        raise ValueError("the stream is no positive multiple of 188 bytes")
    packets = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (packets[:, 0] != 0x47).any():
        raise ValueError("a packet has no sync byte")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    first = lambda pid: tuple(packets[k].tobytes() for k in np.flatnonzero(pids == pid)[:8])  # noqa: E731  a section has 1,024 bytes at most
    kind, pid = _elementary_stream(first(_data_stream(first(0))))
    own = np.flatnonzero(pids == pid)
    mine = packets[own]
    has_data = mine[:, 3] & 0x10 > 0
    twice = np.concatenate(([False], has_data[1:] & has_data[:-1] & (mine[1:, 3] & 15 == mine[:-1, 3] & 15)))[: len(mine)]
    if twice.any():
        own, mine, has_data = own[~twice], mine[~twice], has_data[~twice]
    has_field = mine[:, 3] & 0x20 > 0
    jumps = has_field & (mine[:, 4] > 0) & (mine[:, 5] & 0x80 > 0)
    counters = mine[has_data, 3] & 15
    errors = int(((((counters[1:] - counters[:-1]) & 15) != 1) & ~jumps[has_data][1:]).sum())
    begin = np.where(has_field, 5 + mine[:, 4].astype(np.int32), 4)
    begin[~has_data] = PACKET
    access = has_field & (mine[:, 4] > 0) & (mine[:, 5] & 0x40 > 0)
    size = np.maximum(PACKET - begin, 0)
    data = mine[np.arange(PACKET) >= begin[:, None]]
    at = (np.cumsum(size) - size)[mine[:, 1] & 0x40 > 0]
    if not len(at) or at[0] or at[-1] + HEADER > len(data):
        raise ValueError("an elementary packet is cut short")
    head = data[at[:, None] + np.arange(HEADER)].astype(np.int64)
    if (head[:, :3] != (0, 0, 1)).any() or (head[:, 7] & 0x80 == 0).any():
        raise ValueError("an elementary packet is broken")
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | (head[:, 11] >> 1) << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    lengths = head[:, 4] << 8 | head[:, 5]
    if not np.array_equal(at + 6 + lengths, np.append(at[1:], len(data))):
        raise ValueError("an elementary packet is cut short")
    keep = np.ones(len(data), bool)
    skip = 9 + head[:, 8]
    for a, s in zip(at.tolist(), skip.tolist()):
        keep[a : a + s] = False
    return {"payload": data[keep].tobytes(), "timestamps": pts.tolist(), "random_access": own[access].tolist(), "continuity_errors": errors, "stream_type": kind, "pid": pid, "packets": len(packets)}


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data = [t.encode() for t in batch.column("text").to_pylist()]
        media = [multiplex(pad(d)) for d in data]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [demultiplex(m) for m in batch.column("media").to_pylist()]
        columns = {
            "payload_bytes": pa.array([len(x["payload"]) for x in found], pa.int64()),
            "payload_sha256": pa.array([hashlib.sha256(x["payload"]).hexdigest() for x in found], pa.string()),
            "tail_crc32": pa.array([zlib.crc32(x["payload"][-16:]) for x in found], pa.int64()),
            "timestamps": pa.array([x["timestamps"] for x in found], pa.list_(pa.int64())),
            "random_access": pa.array([x["random_access"] for x in found], pa.list_(pa.int32())),
            "continuity_errors": pa.array([x["continuity_errors"] for x in found], pa.int32()),
            "stream_type": pa.array([x["stream_type"] for x in found], pa.int32()),
            "pid": pa.array([x["pid"] for x in found], pa.int32()),
            "packets": pa.array([x["packets"] for x in found], pa.int32()),
        }
        yield pa.RecordBatch.from_arrays([*batch.columns, *columns.values()], names=[*batch.schema.names, *columns])


def write_streams(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (the transport stream) of every row."""
    src = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return src.mapInArrow(_write, T.StructType([src.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())]))


def read_streams(streams: DataFrame) -> DataFrame:
    """The input's columns and what the stored streams hold."""
    added = "payload_bytes long, payload_sha256 string, tail_crc32 long, timestamps array<long>, random_access array<int>, continuity_errors int, stream_type int, pid int, packets int"
    return streams.mapInArrow(_read, T.StructType([*streams.schema.fields, *T._parse_datatype_string(added).fields]))


def op9_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract digest of the streams of all documents, read back from their stored bytes."""
    back = read_streams(write_streams(table(spark, sf_dir, "documents")))
    numbers = lambda c: F.crc32(F.concat_ws(",", F.col(c).cast("array<string>")))
    feature = F.format_string(
        "packets=%d;pid=%d;type=%d;pes=%d;cc_errors=%d;first_pts=%d;last_pts=%d;pts_crc32=%d;rap=%d;rap_crc32=%d",
        "packets", "pid", "stream_type", F.size("timestamps"), "continuity_errors", F.element_at("timestamps", 1), F.element_at("timestamps", -1), numbers("timestamps"), F.size("random_access"), numbers("random_access"),
    )
    return back.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))
