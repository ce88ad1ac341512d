"""Texts as MPEG transport streams in a binary column, with timestamps and random-access points beside it.

A stream starts with its program tables (PAT, PMT). The payload is cut into elementary packets (PES) with one timestamp each,
and these into 188-byte packets with continuity counters. Reading parses the tables to find the elementary stream, checks the
counters, reassembles the elementary packets and returns exactly the bytes that were stored. Packets of a stream are built and
taken apart as rows of one array, not one at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from haulwise.llm.columns import append_columns

PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, PROGRAM = 0x0000, 0x1000, 0x0100, 1
PRIVATE_DATA = 0x06  # stream type: packets of private data
PRIVATE_STREAM = 0xBD  # stream id: private stream 1
PES_BYTES = 16_000
TICKS_PER_PES = 3600  # of the 90 kHz clock
RANDOM_ACCESS_EVERY = 4
BLOCK = 64


def crc32_mpeg(content: bytes) -> int:
    """The checksum of program tables: polynomial 0x04C11DB7, high bit first, start value all ones."""
    value = 0xFFFFFFFF
    for byte in content:
        value ^= byte << 24
        for _ in range(8):
            value = (value << 1 ^ 0x04C11DB7 if value & 0x80000000 else value << 1) & 0xFFFFFFFF
    return value


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    """A program table in a packet of its own."""
    section = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2) + number.to_bytes(2) + b"\xc1\x00\x00" + body
    section += crc32_mpeg(section).to_bytes(4)
    return (bytes([SYNC]) + (0x4000 | pid).to_bytes(2) + b"\x10\x00" + section).ljust(PACKET, b"\xff")


TABLES = np.frombuffer(
    _table_packet(PAT_PID, 0x00, 1, PROGRAM.to_bytes(2) + (0xE000 | PMT_PID).to_bytes(2))
    + _table_packet(PMT_PID, 0x02, PROGRAM, (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\x00" + bytes([PRIVATE_DATA]) + (0xE000 | DATA_PID).to_bytes(2) + b"\xf0\x00"),
    dtype=np.uint8,
).reshape(-1, PACKET)


def _stamp(ticks: int) -> bytes:
    """A presentation timestamp in its five bytes."""
    return bytes([0x21 | ticks >> 29 & 0x0E, ticks >> 22 & 0xFF, ticks >> 14 & 0xFE | 1, ticks >> 7 & 0xFF, ticks << 1 & 0xFE | 1])


def _ticks(stamp: bytes) -> int:
    return (stamp[0] & 0x0E) << 29 | stamp[1] << 22 | (stamp[2] & 0xFE) << 14 | stamp[3] << 7 | stamp[4] >> 1


def _clock(ticks: int) -> bytes:
    """The program clock reference: 33 bits of the 90 kHz clock, six set bits, extension 0."""
    return (ticks << 15 | 0x7E00).to_bytes(6)


def _packets(pes: bytes, counter: int, ticks: int, random_access: bool) -> np.ndarray:
    """The transport packets of one elementary packet."""
    lead = bytes([7, 0x50]) + _clock(ticks) if random_access else b""  # adaptation field: random access, clock
    room, content = PACKET - 4, np.frombuffer(pes, dtype=np.uint8)
    count = -(-(len(pes) + len(lead)) // room)
    out = np.empty((count, PACKET), dtype=np.uint8)
    out[:, 0], out[:, 1], out[:, 2] = SYNC, DATA_PID >> 8, DATA_PID & 0xFF
    out[:, 3] = 0x10 | (np.arange(counter, counter + count) & 15)
    out[0, 1] |= 0x40
    if lead:
        out[0, 3] |= 0x20
        out[0, 4 : 4 + len(lead)] = np.frombuffer(lead, dtype=np.uint8)
    stuffing = count * room - len(pes) - len(lead)
    if stuffing == 0:
        flat = out[:, 4:].reshape(-1)
        flat[len(lead) :] = content
        out[:, 4:] = flat.reshape(count, room)
        return out
    flat = np.empty(count * room, dtype=np.uint8)
    last = room * (count - 1)
    own_lead = lead if count == 1 else b""
    if count > 1:
        flat[: len(lead)] = np.frombuffer(lead, dtype=np.uint8)
        flat[len(lead) : last] = content[: last - len(lead)]
        content = content[last - len(lead) :]
    # The last packet is filled up by its adaptation field.
    out[-1, 3] |= 0x20
    size = len(own_lead) + stuffing
    flat[last : last + size] = 0xFF
    flat[last] = size - 1
    if own_lead:
        flat[last + 1 : last + len(own_lead)] = np.frombuffer(own_lead[1:], dtype=np.uint8)
    elif size > 1:
        flat[last + 1] = 0
    flat[last + size :] = content
    out[:, 4:] = flat.reshape(count, room)
    return out


def mux(payload: bytes) -> bytes:
    """The transport stream of a payload."""
    parts, counter = [TABLES], 0
    for number, at in enumerate(range(0, len(payload), PES_BYTES)):
        chunk, ticks = payload[at : at + PES_BYTES], number * TICKS_PER_PES % (1 << 33)
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(chunk) + 8).to_bytes(2) + b"\x80\x80\x05" + _stamp(ticks) + chunk
        packets = _packets(pes, counter, ticks, number % RANDOM_ACCESS_EVERY == 0)
        counter += len(packets)
        parts.append(packets)
    return np.concatenate(parts).tobytes()


@dataclass
class Stream:
    """What a transport stream holds."""

    payload: bytes
    packets: int
    stream_type: int
    counter_errors: int
    stamps: list[int] = field(default_factory=list)
    random_access: list[int] = field(default_factory=list)  # number of the transport packet where decoding can start


def _section(packets: np.ndarray, pid: int, pids: np.ndarray, table_id: int) -> bytes:
    found = packets[(pids == pid) & (packets[:, 1] & 0x40 > 0)]
    if not len(found):
        raise ValueError(f"no table on PID {pid}")
    raw = found[0, 5 + int(found[0, 4]) :].tobytes()
    section = raw[: 3 + (int.from_bytes(raw[1:3]) & 0x0FFF)]
    if section[0] != table_id or crc32_mpeg(section):
        raise ValueError(f"the table on PID {pid} is damaged")
    return section[8:-4]


_SECTIONS: dict[tuple[bytes, ...], tuple[int, int]] = {}


def _elementary(packets: np.ndarray, pids: np.ndarray) -> tuple[int, int]:
    """(PID, stream type) of the first elementary stream of the first program. Tables seen before are not parsed again."""
    key = (packets[0].tobytes(), packets[1].tobytes() if len(packets) > 1 else b"")
    if key not in _SECTIONS:
        programs = _section(packets, PAT_PID, pids, 0x00)
        pmt = _section(packets, int.from_bytes(programs[2:4]) & 0x1FFF, pids, 0x02)
        entry = pmt[4 + (int.from_bytes(pmt[2:4]) & 0x0FFF) :]
        if len(_SECTIONS) > 100:
            _SECTIONS.clear()
        _SECTIONS[key] = int.from_bytes(entry[1:3]) & 0x1FFF, entry[0]
    return _SECTIONS[key]


_COLUMNS = np.arange(PACKET)


def demux(stream: bytes) -> Stream:
    """Take a transport stream apart. Lost or repeated packets are counted; broken tables or packets are errors."""
    packets = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if not len(packets) or (packets[:, 0] != SYNC).any():
        raise ValueError("not a transport stream")
    pids = (packets[:, 1] & 0x1F).astype(np.int64) << 8 | packets[:, 2]
    pid, kind = _elementary(packets, pids)
    numbers = np.flatnonzero((pids == pid) & (packets[:, 3] & 0x10 > 0))
    own = packets[numbers]
    errors = int(((np.diff(own[:, 3].astype(np.int64) & 15) & 15) != 1).sum())
    adapted = own[:, 3] & 0x20 > 0
    start = np.where(adapted, 5 + own[:, 4].astype(np.int64), 4)
    content = own[start[:, None] <= _COLUMNS].tobytes()
    ends = np.cumsum(PACKET - start)
    first = own[:, 1] & 0x40 > 0
    begins = (ends - (PACKET - start))[first].tolist()
    out = Stream(b"", len(packets), kind, errors)
    out.random_access = numbers[adapted & (own[:, 4] > 0) & (own[:, 5] & 0x40 > 0)].tolist()
    chunks = []
    for at, after in zip(begins, [*begins[1:], len(content)], strict=True):
        pes = content[at:after]
        size = int.from_bytes(pes[4:6])
        if pes[:3] != b"\x00\x00\x01" or size + 6 != len(pes) or not pes[7] & 0x80:
            raise ValueError("a broken elementary packet")
        out.stamps.append(_ticks(pes[9:14]))
        chunks.append(pes[9 + pes[8] :])
    out.payload = b"".join(chunks)
    return out


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw.ljust(max(BLOCK, -(-len(raw) // BLOCK) * BLOCK), b"\0")


def to_streams(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus n_bytes, media, stamps and random_access.

    media is the transport stream of the text in UTF-8, filled with zero bytes to a positive multiple of 64; n_bytes is its
    length before. A NULL text is an empty one. stamps are the timestamps of the elementary packets, random_access the
    numbers of the packets at which decoding can start. Equal texts give equal streams; an empty table stays empty; input
    columns named like a result are replaced.
    """

    def start():
        def store(texts: pa.Array) -> list[pa.Array]:
            sizes, media, stamps, points = [], [], [], []
            for one in texts.to_pylist():
                payload = padded(one)
                count = -(-len(payload) // PES_BYTES)
                sizes.append(len((one or "").encode()))
                media.append(mux(payload))
                stamps.append([number * TICKS_PER_PES % (1 << 33) for number in range(count)])
                points.append(_points(count, len(payload)))
            return [pa.array(sizes, pa.int64()), pa.array(media, pa.binary()), pa.array(stamps, pa.list_(pa.int64())), pa.array(points, pa.list_(pa.int64()))]

        return store

    return append_columns(docs, [F.col(text)], "n_bytes long, media binary, stamps array<long>, random_access array<long>", start)


def _points(count: int, size: int) -> list[int]:
    """Where the random-access packets of a payload of ``size`` bytes in ``count`` elementary packets lie."""
    at, out = len(TABLES), []
    for number in range(count):
        lead = 8 if number % RANDOM_ACCESS_EVERY == 0 else 0
        if lead:
            out.append(at)
        at += -(-(min(PES_BYTES, size - number * PES_BYTES) + 14 + lead) // (PACKET - 4))
    return out


def read_streams(stored: DataFrame) -> DataFrame:
    """``stored`` with features of what its streams hold in place of media, stamps and random_access.

    Adds payload_bytes, payload_sha256, tail_crc32 (of the last 64 bytes), media_bytes, media_sha256 and feature: counts of
    packets, elementary packets, counter errors and random-access points, stream type, first and last timestamp. A stream
    whose stored timestamps or random-access points differ from those found in it is an error.
    """

    def start():
        def read(media: pa.Array, stamps: pa.Array, points: pa.Array) -> list[pa.Array]:
            rows = []
            for raw, told, places in zip(media, stamps.to_pylist(), points.to_pylist(), strict=True):
                raw = raw.as_py()
                stream = demux(raw)
                if stream.stamps != told or stream.random_access != places:
                    raise ValueError("the index does not belong to this stream")
                feature = (
                    f"packets={stream.packets};pes={len(stream.stamps)};errors={stream.counter_errors};type={stream.stream_type};"
                    f"pts={stream.stamps[0]}-{stream.stamps[-1]};random={len(stream.random_access)}"
                )
                rows.append((
                    len(stream.payload), hashlib.sha256(stream.payload).hexdigest(), zlib.crc32(stream.payload[-BLOCK:]), len(raw),
                    hashlib.sha256(raw).hexdigest(), feature,
                ))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return [pa.array(column, kind) for column, kind in zip(columns, kinds, strict=True)]

        return read

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return append_columns(stored, [F.col("media"), F.col("stamps"), F.col("random_access")], fields, start, drop=("media", "stamps", "random_access"))
