"""Version edits in bytes: tagged fields, one edit a journal chunk, and what a log of them adds up to."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.errors import Corrupted
from tidemark.functions.keys import get_uvarint, put_uvarint
from tidemark.plans.manifest import Edit, File, Version
from tidemark.sources import journal

# The tags of the format.
COMPARER, JOURNAL, NEXT_FILE, SEQ, POINTER, DELETED, ADDED = 1, 2, 3, 4, 5, 6, 7
# Bytes of a log that one row of a distributed log holds, about.
SEGMENT = 1 << 20


def _bytes(b: bytes) -> bytes:
    return put_uvarint(len(b)) + b


def encode(edit: Edit) -> bytes:
    out: list[bytes] = []
    if edit.comparer is not None:
        out += [put_uvarint(COMPARER), _bytes(edit.comparer.encode())]
    for tag, value in ((JOURNAL, edit.journal), (NEXT_FILE, edit.next_file), (SEQ, edit.seq)):
        if value is not None:
            out += [put_uvarint(tag), put_uvarint(value)]
    for level, key in sorted(edit.pointers.items()):
        out += [put_uvarint(POINTER), put_uvarint(level), _bytes(key)]
    for level, num in edit.delete:
        out += [put_uvarint(DELETED), put_uvarint(level), put_uvarint(num)]
    for f in edit.add:
        out += [put_uvarint(ADDED), put_uvarint(f.level), put_uvarint(f.num), put_uvarint(f.size), _bytes(f.min_key), _bytes(f.max_key)]
    return b"".join(out)


def decode(data: bytes) -> Edit:
    at, edit = 0, Edit()

    def number() -> int:
        nonlocal at
        n, at = get_uvarint(data, at)
        return n

    def text() -> bytes:
        nonlocal at
        n = number()
        if at + n > len(data):
            raise Corrupted("version edit cut short")
        at += n
        return data[at - n : at]

    while at < len(data):
        tag = number()
        if tag == COMPARER:
            edit.comparer = text().decode()
        elif tag == JOURNAL:
            edit.journal = number()
        elif tag == NEXT_FILE:
            edit.next_file = number()
        elif tag == SEQ:
            edit.seq = number()
        elif tag == POINTER:
            level = number()
            edit.pointers[level] = text()
        elif tag == DELETED:
            level = number()
            edit.delete.append((level, number()))
        elif tag == ADDED:
            level, num, size = number(), number(), number()
            edit.add.append(File(level, num, size, text(), text()))
        else:
            raise Corrupted(f"unknown tag {tag} in a version edit")
    return edit


def snapshot(version: Version) -> Edit:
    """A version as one edit: the first record of a new log."""
    return Edit(add=sorted(version.files, key=lambda f: (f.level, f.num)), seq=version.seq, next_file=version.next_file, journal=version.journal, comparer=version.comparer, pointers=dict(version.pointers))


def write_log(edits: list[Edit]) -> bytes:
    out = journal.Writer()
    for e in edits:
        out.chunk(encode(e))
    return bytes(out.data)


def total(edits: Iterable[Edit]) -> tuple[Edit, int]:
    """(one edit that does what the edits do after each other, how many they are): the last action of each file counts."""
    files: dict[tuple[int, int], File | None] = {}
    out, n = Edit(), 0
    for e in edits:
        n += 1
        if e.add and e.delete:
            e = e.net()
        for d in e.delete:
            files.pop(d, None)
            files[d] = None
        for f in e.add:
            files.pop((f.level, f.num), None)
            files[f.level, f.num] = f
        for name in ("seq", "next_file", "journal"):
            if (value := getattr(e, name)) is not None:
                setattr(out, name, max(value, getattr(out, name) or 0))
        if e.comparer is not None:
            out.comparer = e.comparer or out.comparer or ""
        out.pointers.update(e.pointers)
    out.add, out.delete = [f for f in files.values() if f], [d for d, f in files.items() if not f]
    return out, n


def recovered(edit: Edit, n: int, where: str = "") -> Version:
    """The version that n edits of this total make. Comparer, sequence number, next file and journal must each have been set by some edit."""
    if missing := [name for name in ("comparer", "journal", "next_file", "seq") if getattr(edit, name) is None]:
        raise Corrupted(f"no edit sets {', '.join(missing)}", where)
    return replace(Version(comparer="").apply(edit), number=n)


def recover(data: bytes, where: str = "") -> Version:
    """Fold all edits of a log."""
    return recovered(*total(decode(chunk) for chunk in journal.chunks(data)), where)


# ---- logs of any length, as rows (place, data): segments in the order of their place, each a log by itself

SEGMENTS = "place long, data binary"


def segments(edits: DataFrame, make: Callable[[dict], Edit], order: list[str]) -> DataFrame:
    """The edits in their order as a log; make gives the edit of a row. A task holds one segment of what it writes."""
    schema = pa.schema([("place", pa.int64()), ("data", pa.binary())])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def cut() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([place], pa.int64()), pa.array([bytes(out.data)], pa.binary())], schema=schema)

        out, place = journal.Writer(), TaskContext.get().partitionId() << 33
        for b in blocks:
            for r in b.to_pylist():
                out.chunk(encode(make(r)))
                if len(out.data) >= SEGMENT:
                    yield cut()
                    out, place = journal.Writer(), place + 1
        if out.data:
            yield cut()

    return edits.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(run, SEGMENTS)


def recover_segments(log: DataFrame, where: str = "") -> Version:
    """recover of a log in segments. Each is folded where it lies; of what the segments say of a file the last counts. A task reads
    them in Arrow batches, which Spark ends at 64 MiB. A row a live file reaches the driver, and one a pointer."""
    schema = pa.schema([("place", pa.int64()), ("what", pa.string()), ("level", pa.int32()), ("num", pa.int64()), ("size", pa.int64()), ("min_key", pa.binary()), ("max_key", pa.binary()), ("n", pa.int64()), ("seq", pa.int64()), ("next_file", pa.int64()), ("journal", pa.int64()), ("comparer", pa.string())])
    rows_of = "place long, what string, level int, num long, size long, min_key binary, max_key binary, n long, seq long, next_file long, journal long, comparer string"

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            for place, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                e, n = total(decode(chunk) for chunk in journal.chunks(data.as_py()))
                rows = [{"what": "all", "n": n, "seq": e.seq, "next_file": e.next_file, "journal": e.journal, "comparer": e.comparer}]
                rows += [{"what": "pointer", "level": level, "max_key": key} for level, key in e.pointers.items()]
                rows += [{"what": "del", "level": level, "num": num} for level, num in e.delete]
                rows += [{"what": "add", "level": f.level, "num": f.num, "size": f.size, "min_key": f.min_key, "max_key": f.max_key} for f in e.add]
                for k in range(0, len(rows), 4096):
                    yield pa.RecordBatch.from_pylist([{"place": place, **r} for r in rows[k : k + 4096]], schema=schema)

    parts = log.select("place", "data").mapInArrow(run, rows_of)
    last = F.max_by(F.struct("what", "size", "min_key", "max_key"), "place").alias("last")
    scalars = [F.sum("n").alias("n"), *(F.max(c).alias(c) for c in ("seq", "next_file", "journal")), F.max_by("comparer", F.when(F.length("comparer") > 0, F.col("place"))).alias("comparer"), F.max("comparer").alias("any_comparer")]
    of_file = F.when(F.col("what").isin("add", "del"), "file").otherwise(F.col("what")).alias("of")
    edit, n = Edit(), 0
    for r in parts.groupBy(of_file, "level", "num").agg(last, *scalars).where("last.what <> 'del'").toLocalIterator():
        if r["of"] == "file":
            edit.add.append(File(r["level"], r["num"], r["last"]["size"], bytes(r["last"]["min_key"]), bytes(r["last"]["max_key"])))
        elif r["of"] == "pointer":
            edit.pointers[r["level"]] = bytes(r["last"]["max_key"])
        else:
            n, edit.seq, edit.next_file, edit.journal = r["n"], r["seq"], r["next_file"], r["journal"]
            edit.comparer = r["any_comparer"] if r["comparer"] is None else r["comparer"]
    return recovered(edit, n, where)
