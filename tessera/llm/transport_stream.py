"""Media columns: MPEG transport streams written, parsed and checked.

A payload becomes one program with one private elementary stream. It is cut into access units, one PES packet each, that
carry presentation timestamps of a 90 kHz clock; every so many units a packet is marked as a random-access point and
carries the clock reference. The parser follows the program association and map tables, checks their CRCs and the
continuity counter of every stream, reassembles the PES packets, and returns timestamps and random-access points.

Defined cases: a null payload is an empty one; an empty payload gives the tables alone (the query pads first, so never);
very long payloads take more packets; equal payloads give equal bytes; damaged packets are counted, never raised.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.shared import documents, pieces_of

# Fixed values of the format.
PACKET, SYNC, CLOCK_HZ = 188, 0x47, 90_000
PAT_PID, PMT_PID, MEDIA_PID, NULL_PID = 0x0000, 0x1000, 0x0100, 0x1FFF
PRIVATE_STREAM, PRIVATE_PES = 0xBD, 0x06
CRC_POLYNOMIAL = 0x04C11DB7

#: Parameters of the writer: bytes of an access unit, its ticks, and units from one random-access point to the next.
UNIT_BYTES, UNIT_TICKS, UNITS_A_GROUP = 3840, 3600, 8


@functools.cache
def _crc_table() -> tuple[int, ...]:
    table = []
    for byte in range(256):
        value = byte << 24
        for _ in range(8):
            value = (value << 1 ^ CRC_POLYNOMIAL if value >> 31 else value << 1) & 0xFFFFFFFF
        table.append(value)
    return tuple(table)


@functools.lru_cache(256)
def section_crc(section: bytes) -> int:
    """CRC-32/MPEG-2; over a section with its own CRC it is 0."""
    table, value = _crc_table(), 0xFFFFFFFF
    for byte in section:
        value = value << 8 & 0xFFFFFFFF ^ table[value >> 24 ^ byte]
    return value


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _header(pid: int, start: bool, control: int, counter: int) -> bytes:
    return bytes([SYNC, start << 6 | pid >> 8, pid & 255, control << 4 | counter & 15])


@functools.cache
def _tables() -> bytes:
    pat = _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    pmt = _section(2, 1, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_PES]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00")
    return b"".join((_header(pid, True, 1, 0) + b"\x00" + table).ljust(PACKET, b"\xff") for pid, table in ((PAT_PID, pat), (PMT_PID, pmt)))


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 29 & 14) | 1, ticks >> 22 & 255, (ticks >> 14 & 254) | 1, ticks >> 7 & 255, (ticks << 1 & 254) | 1])


def _read_stamp(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | b[1] << 22 | (b[2] >> 1) << 15 | b[3] << 7 | b[4] >> 1


@functools.lru_cache(4096)
def _adaptation(size: int, random_access: bool, ticks: int) -> bytes:
    """An adaptation field of so many bytes in all, its length byte included."""
    if size == 1:
        return b"\x00"
    flags, body = 0x40 * random_access, b""
    if random_access:
        flags, body = flags | 0x10, (ticks << 15 | 0x7E00).to_bytes(6, "big")
    return (bytes([size - 1, flags]) + body).ljust(size, b"\xff")


def write_stream(payload: bytes, unit_bytes: int = UNIT_BYTES, unit_ticks: int = UNIT_TICKS, units_a_group: int = UNITS_A_GROUP) -> bytes:
    """A transport stream that holds the payload."""
    out, counter = [_tables()], 0
    for k, at in enumerate(range(0, len(payload), unit_bytes)):
        unit, ticks, key = payload[at : at + unit_bytes], k * unit_ticks & 0x1FFFFFFFF, k % units_a_group == 0
        pes = b"\x00\x00\x01" + bytes([PRIVATE_STREAM]) + (len(unit) + 8).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(2, ticks) + unit
        done, start = 0, True
        while done < len(pes):
            size = 8 if key and start else 0
            left = len(pes) - done
            if left < 184 - size:
                size = 184 - left
            if size:
                out += (_header(MEDIA_PID, start, 3, counter), _adaptation(size, key and start, ticks if key and start else 0), pes[done : done + 184 - size])
            else:
                out += (_header(MEDIA_PID, start, 1, counter), pes[done : done + 184])
            done, start, counter = done + 184 - size, False, counter + 1
    return b"".join(out)


@dataclass
class Stream:
    """What a transport stream holds. units: of each access unit its PID, timestamp (-1: none), packet, whether a decoder can begin there, and bytes."""

    packets: int = 0
    lost_bytes: int = 0
    continuity_errors: int = 0
    table_errors: int = 0
    programs: dict[int, int] = field(default_factory=dict)
    streams: dict[int, int] = field(default_factory=dict)
    units: list[tuple[int, int, int, bool, bytes]] = field(default_factory=list)

    def payload(self, pid: int | None = None) -> bytes:
        return b"".join(u[4] for u in self.units if pid in (None, u[0]))


def _read_table(found: Stream, section: bytes, pid: int) -> None:
    if section_crc(section):
        found.table_errors += 1
    elif pid == PAT_PID and section[0] == 0:
        for at in range(8, len(section) - 4, 4):
            if program := int.from_bytes(section[at : at + 2], "big"):
                found.programs[program] = int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
    elif section[0] == 2:
        at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        while at + 5 <= len(section) - 4:
            found.streams[int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF] = section[at]
            at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)


def read_stream(data: bytes) -> Stream:
    """Parse a transport stream. Bytes out of step are skipped to the next sync byte and counted."""
    found, last, parts, at = Stream(), {}, {}, 0

    def ended(pid: int) -> None:
        packet, random_access, chunks = parts.pop(pid)
        pes = b"".join(chunks)
        if len(pes) < 9 or pes[:3] != b"\x00\x00\x01":
            found.lost_bytes += len(pes)
            return
        length, begin = int.from_bytes(pes[4:6], "big"), 9 + pes[8]
        found.units.append((pid, _read_stamp(pes[9:14]) if pes[7] & 0x80 and pes[8] >= 5 else -1, packet, random_access, pes[begin : 6 + length if length else None]))

    while at + PACKET <= len(data):
        if data[at] != SYNC:
            step = data.find(b"\x47", at)
            step = len(data) if step < 0 else step
            found.lost_bytes, at = found.lost_bytes + step - at, step
            continue
        b1, b3 = data[at + 1], data[at + 3]
        pid, begin, random_access, jump = (b1 & 31) << 8 | data[at + 2], at + 4, False, False
        found.packets += 1
        if b3 & 0x20:
            if length := data[begin]:
                flags = data[begin + 1]
                random_access, jump = bool(flags & 0x40), bool(flags & 0x80)
            begin += 1 + length
        end = at = at + PACKET
        if pid == NULL_PID or not b3 & 0x10 or begin >= end:
            continue
        counter = b3 & 15
        before = last.get(pid)
        if before is not None and counter != before + 1 & 15 and not jump:
            if counter == before:
                continue  # a packet sent twice
            found.continuity_errors += 1
        last[pid] = counter
        if pid == PAT_PID or pid in found.programs.values():
            if b1 & 0x40:
                parts[pid] = (found.packets, False, [data[begin + 1 + data[begin] : end]])
            elif pid in parts:
                parts[pid][2].append(data[begin:end])
            section = b"".join(parts[pid][2]) if pid in parts else b""
            if len(section) >= 3 and len(section) >= (size := 3 + (int.from_bytes(section[1:3], "big") & 0xFFF)):
                parts.pop(pid)
                _read_table(found, section[:size], pid)
        elif pid in found.streams:
            if b1 & 0x40:
                if pid in parts:
                    ended(pid)
                parts[pid] = (found.packets - 1, random_access, [data[begin:end]])
            elif pid in parts:
                parts[pid][2].append(data[begin:end])
            else:
                found.lost_bytes += end - begin
    found.lost_bytes += len(data) - at
    for pid in [p for p in parts if p in found.streams]:
        ended(pid)
    return found


def store_media(df: DataFrame, payload: str = "payload", media: str = "media") -> DataFrame:
    """Add the column media: the payload (binary; null: empty) as a transport stream. The payload column goes."""
    rest = [c for c in df.columns if c not in (payload, media)]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{media}` binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, payload):
            made = pa.array([write_stream(x or b"") for x in b.column(b.schema.get_field_index(payload)).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), made], names=[*rest, media])

    return df.select(*rest, payload).mapInArrow(run, schema)


PARSED = pa.struct([
    ("payload", pa.binary()), ("packets", pa.int64()), ("lost_bytes", pa.int64()), ("continuity_errors", pa.int64()), ("table_errors", pa.int64()),
    ("programs", pa.int64()), ("timestamps", pa.list_(pa.int64())), ("random_access", pa.list_(pa.struct([("packet", pa.int64()), ("timestamp", pa.int64())]))),
])


def parse_media(df: DataFrame, media: str = "media", parsed: str = "parsed") -> DataFrame:
    """Add the struct column parsed: the reassembled payload, counts of packets and faults, timestamps and random-access points."""
    rest = [c for c in df.columns if c != parsed]
    kind = "struct<payload: binary, packets: bigint, lost_bytes: bigint, continuity_errors: bigint, table_errors: bigint, programs: bigint, timestamps: array<bigint>, random_access: array<struct<packet: bigint, timestamp: bigint>>>"
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in rest), f"`{parsed}` {kind}"])

    def row(data: bytes | None) -> dict:
        s = read_stream(data or b"")
        return {
            "payload": s.payload(), "packets": s.packets, "lost_bytes": s.lost_bytes, "continuity_errors": s.continuity_errors, "table_errors": s.table_errors, "programs": len(s.programs),
            "timestamps": [u[1] for u in s.units], "random_access": [{"packet": u[2], "timestamp": u[1]} for u in s.units if u[3]],
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces_of(batches, media):
            made = pa.array([row(x) for x in b.column(b.schema.get_field_index(media)).to_pylist()], PARSED)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in rest), made], names=[*rest, parsed])

    return df.select(*rest).mapInArrow(run, schema)


def op7_transport_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as UTF-8, padded with blanks to a positive multiple of 192 bytes, through a transport stream and back. Null texts count as empty; repeated rows give equal rows."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    docs = documents(spark, sf_dir).select("doc_id", text.alias("raw"))
    n = F.octet_length("raw").cast("long")
    pad = (F.greatest(F.lit(192), F.ceil(n / 192) * 192) - n).cast("int")
    docs = docs.select("doc_id", n.alias("n_bytes"), F.concat("raw", F.repeat(F.lit(" "), pad).cast("binary")).alias("payload"))
    out = parse_media(store_media(docs))
    p = F.col("parsed")
    points, stamps = p["random_access"], p["timestamps"]
    feature = F.concat_ws(
        ";", F.concat(F.lit("packets="), p["packets"]), F.concat(F.lit("units="), F.size(stamps)), F.concat(F.lit("random_access="), F.size(points)), F.concat(F.lit("last_packet="), F.element_at(points, -1)["packet"]),
        F.concat(F.lit("first_pts="), stamps[0]), F.concat(F.lit("last_pts="), F.element_at(stamps, -1)), F.concat(F.lit("continuity_errors="), p["continuity_errors"]), F.concat(F.lit("table_errors="), p["table_errors"]), F.concat(F.lit("lost_bytes="), p["lost_bytes"]),
    )
    return out.select(
        "doc_id", "n_bytes", F.octet_length(p["payload"]).cast("long").alias("payload_bytes"), F.sha2(p["payload"], 256).alias("payload_sha256"), F.crc32(F.substring(p["payload"], -16, 16)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"), (F.size(stamps) * F.lit(UNIT_TICKS * 1000 // CLOCK_HZ)).cast("long").alias("duration_ms"),
    )
