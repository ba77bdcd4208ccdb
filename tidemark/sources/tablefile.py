"""The row-block table format as an optional codec: prefix-coded blocks, filters, index, footer.

The store itself keeps Parquet; this reads and writes the block form for exchange. Every block ends with a compression
type byte (0: none) and CRC-32 of all before it.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

from tidemark.errors import Corrupted
from tidemark.functions.bloom import Bloom
from tidemark.functions.keys import get_uvarint, put_uvarint, separator, successor

# Fixed values of the format.
MAGIC = bytes.fromhex("57fb808b247547db")
FOOTER, FILTER_BASE, FILTER_NAME = 48, 11, b"filter.bloomfilter"
U32 = struct.Struct("<I")


def build_block(rows: list[tuple[bytes, bytes]], restart: int = 16) -> bytes:
    """Entries: shared length, rest's length, value's length, rest, value; every restart-th entry shares nothing."""
    out, restarts, before = bytearray(), [], b""
    for i, (key, value) in enumerate(rows):
        if i % restart == 0:
            restarts.append(len(out))
            shared = 0
        else:
            shared = next((n for n, (a, b) in enumerate(zip(before, key, strict=False)) if a != b), min(len(before), len(key)))
        out += put_uvarint(shared) + put_uvarint(len(key) - shared) + put_uvarint(len(value)) + key[shared:] + value
        before = key
    return bytes(out) + b"".join(U32.pack(r) for r in restarts or [0]) + U32.pack(len(restarts) or 1)


class Block:
    """Scan and seek of a block's entries."""

    def __init__(self, data: bytes):
        if len(data) < 8:
            raise Corrupted("block too short")
        n = U32.unpack_from(data, len(data) - 4)[0]
        self.end = len(data) - 4 - 4 * n
        if n < 1 or self.end < 0:
            raise Corrupted("block with a wrong number of restarts")
        self.data, self.restarts = data, [U32.unpack_from(data, self.end + 4 * i)[0] for i in range(n)]

    def scan(self, at: int = 0) -> Iterator[tuple[bytes, bytes]]:
        key = b""
        while at < self.end:
            shared, at = get_uvarint(self.data, at)
            rest, at = get_uvarint(self.data, at)
            size, at = get_uvarint(self.data, at)
            if shared > len(key) or at + rest + size > self.end:
                raise Corrupted("block entry cut short")
            key = key[:shared] + self.data[at : at + rest]
            yield key, self.data[at + rest : at + rest + size]
            at += rest + size

    def seek(self, key: bytes) -> Iterator[tuple[bytes, bytes]]:
        """Entries from the first at or above key: the restart before it by binary search, then a scan."""
        if self.end == 0:
            return
        first = lambda r: next(self.scan(r))[0]
        i = max(0, bisect_left(self.restarts, key, key=first) - 1)
        for k, v in self.scan(self.restarts[i]):
            if k >= key:
                yield k, v


def seal(block: bytes) -> bytes:
    return block + b"\0" + U32.pack(zlib.crc32(block + b"\0"))


def unseal(data: bytes, handle: bytes) -> bytes:
    at, p = get_uvarint(handle, 0)
    n, _ = get_uvarint(handle, p)
    whole = data[at : at + n + 5]
    if len(whole) < n + 5 or zlib.crc32(whole[: n + 1]) != U32.unpack_from(whole, n + 1)[0]:
        raise Corrupted("block checksum")
    if whole[n]:
        raise Corrupted("unknown compression")
    return whole[:n]


def build_table(rows: list[tuple[bytes, bytes]], block_size: int = 2 << 10, restart: int = 16, bloom_bits: int = 10, user_key=lambda k: k) -> bytes:
    """A table of ascending rows; the filter of each 2 KiB of data offsets has the user keys of the blocks that begin there."""
    out = bytearray()
    index: list[tuple[bytes, bytes]] = []
    segments: dict[int, list[bytes]] = {}

    def put(block: bytes) -> bytes:
        handle = put_uvarint(len(out)) + put_uvarint(len(block))
        out.extend(seal(block))
        return handle

    held: list[tuple[bytes, bytes]] = []
    size = 0
    for i, (k, v) in enumerate(rows):
        if i and k <= rows[i - 1][0]:
            raise ValueError("keys must ascend")
        held.append((k, v))
        size += len(k) + len(v) + 3
        if size >= block_size or i + 1 == len(rows):
            segments.setdefault(len(out) >> FILTER_BASE, []).extend(user_key(x) for x, _ in held)
            after = separator(k, rows[i + 1][0]) if i + 1 < len(rows) else successor(k)
            index.append((after, put(build_block(held, restart))))
            held, size = [], 0
    filters = [Bloom.build(segments.get(n, []), bloom_bits) if n in segments else b"" for n in range(max(segments, default=-1) + 1)]
    offsets = [sum(map(len, filters[:n])) for n in range(len(filters))]
    body = b"".join(filters)
    meta = put(build_block([(FILTER_NAME, put(body + b"".join(map(U32.pack, offsets)) + U32.pack(len(body)) + bytes([FILTER_BASE])))], 1))
    top = put(build_block(index, 1))
    handles = meta + top
    return bytes(out) + handles + bytes(FOOTER - len(MAGIC) - len(handles)) + MAGIC


class Table:
    """Point reads and scans of a table's bytes."""

    def __init__(self, data: bytes, user_key=lambda k: k):
        if len(data) < FOOTER or data[-len(MAGIC) :] != MAGIC:
            raise Corrupted("not a table: bad magic")
        foot = data[-FOOTER:]
        _, p = get_uvarint(foot, 0)
        _, p = get_uvarint(foot, p)
        self.data, self.user_key = data, user_key
        self.index = Block(unseal(data, foot[p:]))
        meta = dict(Block(unseal(data, foot)).scan())
        self.filters = unseal(data, meta[FILTER_NAME]) if FILTER_NAME in meta else b""

    def maybe(self, key: bytes, offset: int) -> bool:
        """Does the filter of the data offset allow the key?"""
        if not self.filters:
            return True
        base = self.filters[-1]
        n_end = U32.unpack_from(self.filters, len(self.filters) - 5)[0]
        n = (len(self.filters) - 5 - n_end) // 4
        i = offset >> base
        if i >= n:
            return True
        start = U32.unpack_from(self.filters, n_end + 4 * i)[0]
        end = U32.unpack_from(self.filters, n_end + 4 * i + 4)[0]
        return Bloom.may_hold(self.filters[start:end], self.user_key(key))

    def find(self, key: bytes, filtered: bool = False) -> tuple[bytes, bytes] | None:
        """The first entry at or above key; with filtered, None if the filter rules the key out."""
        for _, handle in self.index.seek(key):
            if filtered and not self.maybe(key, get_uvarint(handle, 0)[0]):
                return None
            for row in Block(unseal(self.data, handle)).seek(key):
                return row
            filtered = False
        return None

    def find_key(self, key: bytes) -> bytes | None:
        row = self.find(key)
        return row and row[0]

    def get(self, key: bytes) -> bytes | None:
        row = self.find(key, filtered=True)
        return row[1] if row and row[0] == key else None

    def scan(self) -> Iterator[tuple[bytes, bytes]]:
        for _, handle in self.index.scan():
            yield from Block(unseal(self.data, handle)).scan()
