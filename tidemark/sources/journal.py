"""The write-ahead journal: framing in 32 KiB blocks, batches, and a Spark reader.

A chunk is one batch. A record is CRC-32 of the payload (4 bytes), length (2), type (1: whole, 2: first, 3: middle,
4: last), payload; it never crosses a block, and fewer than 7 bytes at a block's end are zeros. Numbers are little-endian.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemark.errors import BatchHeaderError, Corrupted
from tidemark.functions.keys import get_uvarint, put_uvarint
from tidemark.options import DELETE, PUT

BLOCK, HEADER = 32 << 10, struct.Struct("<IHB")
WHOLE, FIRST, MIDDLE, LAST = 1, 2, 3, 4
BATCH = struct.Struct("<QI")


class Writer:
    """Frames chunks; `written` is how many bytes the last chunk took, its headers and padding included."""

    def __init__(self):
        self.data = bytearray()
        self.written = 0

    def chunk(self, payload: bytes) -> int:
        start = len(self.data)
        left, first = payload, True
        while left:
            room = BLOCK - len(self.data) % BLOCK
            if room < HEADER.size:
                self.data += bytes(room)
                continue
            part, left = left[: room - HEADER.size], left[room - HEADER.size :]
            if not part:  # a header alone fits: the record goes to the next block
                self.data += bytes(room)
                left = payload if first else left
                continue
            kind = (WHOLE if not left else FIRST) if first else (LAST if not left else MIDDLE)
            self.data += HEADER.pack(zlib.crc32(part), len(part), kind) + part
            first = False
        self.written = len(self.data) - start
        return self.written


def records(data: bytes) -> Iterator[tuple[int, int, int, bytes]]:
    """(block, place in it, type, payload). A bad checksum or a zero header drops the rest of its block."""
    for start in range(0, len(data), BLOCK):
        block = data[start : start + BLOCK]
        at = 0
        while at + HEADER.size <= len(block):
            crc, n, kind = HEADER.unpack_from(block, at)
            part = block[at + HEADER.size : at + HEADER.size + n]
            if not WHOLE <= kind <= LAST or len(part) < n or zlib.crc32(part) != crc:
                break
            yield start // BLOCK, at, kind, part
            at += HEADER.size + n


def chunks(data: bytes) -> Iterator[bytes]:
    """Whole chunks in order. Middle and last records without a first are dropped, and so is a chunk that never ends."""
    held: list[bytes] | None = None
    last_block = None
    for block, _, kind, part in records(data):
        if held is not None and last_block is not None and block not in (last_block, last_block + 1):
            held = None
        last_block = block
        if kind == WHOLE:
            held = None
            yield part
        elif kind == FIRST:
            held = [part]
        elif held is not None:
            held.append(part)
            if kind == LAST:
                yield b"".join(held)
                held = None


def encode_batch(base: int, entries: list[tuple[int, bytes, bytes | None]]) -> bytes:
    """entries: (kind, key, value); entry i has sequence number base + i."""
    out = [BATCH.pack(base, len(entries))]
    for kind, key, value in entries:
        out += [bytes([kind]), put_uvarint(len(key)), key]
        if kind == PUT:
            out += [put_uvarint(len(value)), value]
    return b"".join(out)


def decode_batch(data: bytes, expected: int = 0) -> Iterator[tuple[int, int, bytes, bytes | None]]:
    """(seq, kind, key, value) of a batch, which must begin at `expected` or later."""
    if len(data) < BATCH.size:
        raise Corrupted("batch shorter than its header")
    base, n = BATCH.unpack_from(data)
    if base < expected:
        raise BatchHeaderError(expected, base)
    at = BATCH.size
    for i in range(n):
        if at >= len(data) or data[at] not in (PUT, DELETE):
            raise Corrupted("batch entry of unknown kind")
        kind = data[at]
        fields: list[bytes] = []
        at += 1
        for _ in range(2 if kind == PUT else 1):
            size, at = get_uvarint(data, at)
            if at + size > len(data):
                raise Corrupted("batch entry cut short")
            fields.append(data[at : at + size])
            at += size
        yield base + i, kind, fields[0], fields[1] if kind == PUT else None
    if at != len(data):
        raise Corrupted("bytes after the last batch entry")


ROWS = "file string, seq long, kt byte, ukey binary, value binary"


def replay(spark: SparkSession, paths: list[str] | str, since: int = 0) -> DataFrame:
    """Change rows of journal files with seq >= since. A file is read by one task; files are bounded by the write buffer."""
    files = spark.read.format("binaryFile").load(paths)
    schema = pa.schema([("file", pa.string()), ("seq", pa.int64()), ("kt", pa.int8()), ("ukey", pa.binary()), ("value", pa.binary())])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            for path, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = [(path, *r) for c in chunks(content) for r in decode_batch(c) if r[0] >= since]
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[k : k + 4096], strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(run, ROWS)


def encode_rows(changes: DataFrame, batch: int = 1000) -> DataFrame:
    """(ukey, seq, kt, value) binary rows -> (part, data): one journal a partition; runs of seq without gaps are batches."""
    schema = pa.schema([("part", pa.int32()), ("data", pa.binary())])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        out, held, base = Writer(), [], 0
        for b in blocks:
            for ukey, seq, kind, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (seq != base + len(held) or len(held) == batch):
                    out.chunk(encode_batch(base, held))
                    held = []
                if not held:
                    base = seq
                held.append((kind, ukey, value))
        if held:
            out.chunk(encode_batch(base, held))
        if out.data:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([bytes(out.data)])], schema=schema)

    return changes.select("ukey", "seq", "kt", "value").sortWithinPartitions("seq").mapInArrow(run, "part int, data binary")


def decode_rows(journals: DataFrame) -> DataFrame:
    """(data binary) -> change rows."""
    schema = pa.schema([("seq", pa.int64()), ("kt", pa.int8()), ("ukey", pa.binary()), ("value", pa.binary())])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            for content in b.column(0).to_pylist():
                rows = [r for c in chunks(content) for r in decode_batch(c)]
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows[k : k + 4096], strict=True), schema, strict=True)], schema=schema)

    return journals.select("data").mapInArrow(run, "seq long, kt byte, ukey binary, value binary")
