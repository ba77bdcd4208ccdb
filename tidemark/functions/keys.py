"""Internal keys, order-preserving encodings, separators and varints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.errors import Corrupted
from tidemark.options import DELETE, MAX_SEQ, PUT


def pack(ukey: bytes, seq: int, kind: int) -> bytes:
    """ukey and the little-endian 64-bit number seq << 8 | kind."""
    if not 0 <= seq <= MAX_SEQ or kind not in (PUT, DELETE):
        raise ValueError("sequence number or kind out of range")
    return ukey + (seq << 8 | kind).to_bytes(8, "little")


def unpack(key: bytes) -> tuple[bytes, int, int]:
    if len(key) < 8:
        raise Corrupted("internal key shorter than 8 bytes")
    number = int.from_bytes(key[-8:], "little")
    if number & 0xFF not in (PUT, DELETE):
        raise Corrupted(f"kind {number & 0xFF} of an internal key")
    return key[:-8], number >> 8, number & 0xFF


def _little(number: Column) -> Column:
    """Hex of a long's bytes, the lowest first."""
    digits = F.lpad(F.hex(number), 16, "0")
    return F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in range(7, -1, -1)])


def internal_key(ukey: Column, seq: Column, kind: Column) -> Column:
    """The packed form of binary ukey, as binary; the number may use the sign bit, so it is never compared."""
    return F.concat(ukey, F.unhex(_little(F.shiftleft(seq.cast("long"), 8).bitwiseOR(kind.cast("long")))))


def internal_parts(key: Column) -> Column:
    """struct(ukey, seq, kt) of a packed key; null where it is too short, its kind unknown or its number too large."""
    tail = F.hex(F.substring(key, F.length(key) - 7, F.lit(8)))
    big = F.concat(*[F.substring(tail, 2 * i + 1, 2) for i in range(7, -1, -1)])
    seq = F.conv(F.substring(big, 1, 14), 16, 10).cast("long")
    kind = F.conv(F.substring(big, 15, 2), 16, 10).cast("byte")
    made = F.struct(F.substring(key, F.lit(1), F.length(key) - 8).alias("ukey"), seq.alias("seq"), kind.alias("kt"))
    return F.when((F.length(key) >= 8) & kind.isin(PUT, DELETE), made)


def valid(ukey: Column, seq: Column, kind: Column) -> Column:
    return ukey.isNotNull() & seq.between(0, MAX_SEQ) & kind.isin(PUT, DELETE)


def ordered_long(value: Column) -> Column:
    """Binary whose unsigned byte order is the order of the signed long: big-endian with the sign bit turned."""
    flipped = value.cast("long").bitwiseXOR(F.lit(-(1 << 63)))
    return F.unhex(F.lpad(F.hex(flipped), 16, "0"))


def ordered_long_back(key: Column) -> Column:
    h = F.hex(key)
    high = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    low = F.conv(F.substring(h, 9, 8), 16, 10).cast("long")
    return F.shiftleft(high, 32).bitwiseOR(low).bitwiseXOR(F.lit(-(1 << 63)))


def separator(a: bytes, b: bytes) -> bytes:
    """A shortest x with a <= x < b, for a < b."""
    if not a < b:
        raise ValueError("a must be less than b")
    n = next((i for i, (p, q) in enumerate(zip(a, b, strict=False)) if p != q), min(len(a), len(b)))
    for cut in range(n + 1, len(a)):
        # one byte of a raised, what follows left out
        if a[cut - 1] < 0xFF:
            x = a[: cut - 1] + bytes([a[cut - 1] + 1])
            if a <= x < b:
                return x
    return a


def successor(a: bytes) -> bytes:
    """A shortest x >= a; a itself where it has only 0xff."""
    for i, c in enumerate(a):
        if c < 0xFF:
            return a[:i] + bytes([c + 1])
    return a


def put_uvarint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def get_uvarint(data: bytes, at: int) -> tuple[int, int]:
    """(value, place after it)"""
    n = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise Corrupted("varint cut short or too long")
        c = data[at]
        n |= (c & 0x7F) << shift
        at, shift = at + 1, shift + 7
        if c < 0x80:
            return n, at
