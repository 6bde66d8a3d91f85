"""Archives whose members are compressed by the tasks that make them and put together as a stream."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch

#: Compressed bytes that the driver fetches at a time, and bytes of text in one piece of a member.
FETCH, PIECE = 32 << 20, 1 << 20
#: The reflected polynomial of crc32, the empty last block of a deflate stream, 1 January 1980 as a zip date.
POLYNOMIAL, LAST_BLOCK, DATE = 0xEDB88320, b"\x03\x00", 0x21
ALL_16, ALL_32 = 0xFFFF, 0xFFFFFFFF


def flat(df: DataFrame) -> DataFrame:
    """Nested values and timestamps (in the session's time zone) as text; the rest as it is."""
    as_text = ("array", "struct", "map", "timestamp", "variant", "interval")
    return df.select([F.col(f"`{c}`").cast("string").alias(c) if t.startswith(as_text) else F.col(f"`{c}`") for c, t in df.dtypes])


def csv_text(rows: pa.Table | pa.RecordBatch, *, header: bool = False) -> bytes:
    return rows.to_pandas(integer_object_nulls=True).to_csv(index=False, header=header).encode()


def deflated(text: bytes) -> bytes:
    """``text`` as blocks of a deflate stream that end on a whole byte and may be followed by others."""
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    return c.compress(text) + c.flush(zlib.Z_FULL_FLUSH)


def _product(a: int, b: int) -> int:
    """Of two polynomials over bits, modulo that of crc32; the highest bit is the constant term."""
    out = 0
    for bit in range(31, -1, -1):
        if a >> bit & 1:
            out ^= b
        b = b >> 1 ^ (POLYNOMIAL if b & 1 else 0)
    return out


def joined_crc(first: int, second: int, size: int) -> int:
    """The crc32 of two texts one after the other; the second has ``size`` bytes."""
    shift, factor = 1 << 31, 1 << 23  # 1 and x^8
    while size:
        if size & 1:
            shift = _product(shift, factor)
        factor, size = _product(factor, factor), size >> 1
    return _product(shift, first) ^ second


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, piece, body) of a task's rows, with crc32 and size of all its text so far."""
    part, piece, crc, size, kept = TaskContext.get().partitionId(), 0, 0, 0, b""

    def row(text: bytes) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int32()), pa.array([piece], pa.int64()), pa.array([crc], pa.int64()), pa.array([size], pa.int64()), pa.array([deflated(text)], pa.binary())],
            ["part", "piece", "crc", "size", "body"],
        )

    for b in batches:
        text = csv_text(b) if b.num_rows else b""
        crc, size, kept = zlib.crc32(text, crc), size + len(text), kept + text
        if len(kept) >= PIECE:
            yield row(kept)
            piece, kept = piece + 1, b""
    if kept:
        yield row(kept)


@dataclass
class Member:
    """A compressed member: what its headers say, and its bytes."""

    name: str
    crc: int
    size: int
    packed: int
    body: Iterator[bytes]


def small_member(name: str, text: bytes) -> Member:
    body = deflated(text) + LAST_BLOCK
    return Member(name, zlib.crc32(text), len(text), len(body), iter([body]))


def table_member(df: DataFrame, name: str, scratch: Scratch) -> Member:
    """A table as CSV with a header, in the order of its partitions.

    Tasks format and compress their rows in pieces, which are kept as a table below ``scratch``. The driver gets a row
    for each task (checksum and sizes), then the compressed pieces in order, about ``FETCH`` bytes at a time.
    """
    rows = flat(df)
    head = csv_text(rows.limit(0).toArrow(), header=True)
    pieces = scratch.table(rows.toDF(*[f"_{i}" for i in range(len(rows.columns))]).mapInArrow(_pieces, "part int, piece long, crc long, size long, body binary"), f"member-{zlib.crc32(name.encode())}")
    tasks = pieces.groupBy("part").agg(F.max_by("crc", "piece").alias("crc"), F.max("size").alias("size"), F.sum(F.octet_length("body")).alias("packed")).orderBy("part").collect()
    crc = reduce(lambda before, task: joined_crc(before, task["crc"], task["size"]), tasks, zlib.crc32(head))
    first, packed = deflated(head), sum(t["packed"] for t in tasks)

    def body() -> Iterator[bytes]:
        yield first
        if tasks:
            ordered = pieces.repartitionByRange(1 + packed // FETCH, "part", "piece").sortWithinPartitions("part", "piece")
            yield from (bytes(r["body"]) for r in ordered.select("body").toLocalIterator())
        yield LAST_BLOCK

    return Member(name, crc, len(head) + sum(t["size"] for t in tasks), len(first) + packed + len(LAST_BLOCK), body())


def archive(members: Iterator[Member]) -> Iterator[bytes]:
    """The bytes of a zip archive (with 64-bit sizes) of ``members``, each of which is read once, in turn."""
    at, directory, n = 0, [], 0
    for m in members:
        name = m.name.encode()
        extra = struct.pack("<HHQQ", 1, 16, m.size, m.packed)
        common = struct.pack("<HHHHHIIIHH", 45, 0x800, zlib.DEFLATED, 0, DATE, m.crc, ALL_32, ALL_32, len(name), len(extra))
        yield b"PK\x03\x04" + common + name + extra
        yield from m.body
        wide = struct.pack("<HHQQQ", 1, 24, m.size, m.packed, at)
        directory.append(b"PK\x01\x02" + struct.pack("<H", 3 << 8 | 45) + common[:-2] + struct.pack("<HHHHII", len(wide), 0, 0, 0, 0o644 << 16, ALL_32) + name + wide)
        at, n = at + 4 + len(common) + len(name) + len(extra) + m.packed, n + 1
    size = sum(map(len, directory))
    yield from directory
    yield b"PK\x06\x06" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, n, n, size, at)
    yield b"PK\x06\x07" + struct.pack("<IQI", 0, at + size, 1)
    yield b"PK\x05\x06" + struct.pack("<HHHHIIH", 0, 0, ALL_16, ALL_16, ALL_32, ALL_32, 0)
