"""Exact removal of repeated byte strings with suffix arrays built by two-stage sorting.

A string of `width` bytes is repeated if it also starts anywhere else. Its rarest-looking `GRAM` bytes (those of least
hash among all in it) are its anchor: equal strings have equal anchors, so a first pass writes, for every document, its
anchors with the run of windows that each anchor owns (a segment), and only anchors that occur twice can own repeated
windows. What repeats is decided by suffix arrays alone. Of a segment with copies (equal in a 128-bit cryptographic digest of
its bytes) two enter an array by their first suffix; where an anchor also has segments without a copy, all windows of its
different segments do. Suffixes smaller than their successors are sorted directly, the others are induced by a scan over the
buckets. Then the common prefixes of neighbours are computed: a prefix of n bytes at a place makes the n - width + 1 windows
from there on repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_limits, as_bytes, batches, tidy, written

BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
WIDTH = 200
GRAM = 48
CHUNK = 1 << 19
BLOCK = 8192  # segments of one anchor that are sorted in one array; more go to several arrays
ARRAY_BYTES = 1 << 18


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (BASE, INVERSE):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Hasher:
    """64-bit hashes of the substrings of a buffer from prefix sums. They choose anchors; equal hashes prove nothing."""

    up, down = _powers(1)

    def __init__(self, raw: np.ndarray):
        if len(Hasher.up) <= len(raw):
            Hasher.up, Hasher.down = _powers(max(len(raw) + 1, CHUNK + 4 * WIDTH))
        self.sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.up[: len(raw)], out=self.sums[1:])

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return self.mix((self.sums[k:] - self.sums[:n]) * self.down[:n])

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        return h


def sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the (first) least of h[i : i + w] by its upper bits, for each i; as many bits whatever the length of a buffer."""
    n = len(h) - w + 1
    bits = np.uint64(max(21, len(h).bit_length()))
    low = (np.uint64(1) << bits) - np.uint64(1)
    key = np.full(-(-len(h) // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    key[: len(h)] = (h & ~low) | np.arange(len(h), dtype=np.uint64)
    grid = key.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).reshape(-1)
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return (np.minimum(right[:n], left[w - 1 : w - 1 + n]) & low).astype(np.int64)


def digests(data: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two longs each: a 128-bit cryptographic digest, so equal digests are equal bytes."""
    raw = np.frombuffer(b"".join([blake2b(d, digest_size=16).digest() for d in data]), "<i8").reshape(-1, 2)
    return raw[:, 0], raw[:, 1]


def anchors(texts: list[bytes], width: int = WIDTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(text number, anchor hash, first window, number of windows, 16 bytes of digest) of the segments of texts.

    Long texts go in parts that share width - 1 bytes, so every window is in one part and is owned once; a segment that
    a border cuts gives two, in the same way only for texts that agree from their start, which costs nothing but rows.
    """
    pieces, owner, shift = [], [], []
    for k, t in enumerate(texts):
        for at in range(0, max(0, len(t) - width + 1), CHUNK):
            pieces.append(t[at : at + CHUNK + width - 1])
            owner.append(k)
            shift.append(at)
    out: list[tuple] = []
    k = 0
    while k < len(pieces):
        stop, size = k, 0
        while stop < len(pieces) and (stop == k or size + len(pieces[stop]) <= CHUNK):
            size += len(pieces[stop])
            stop += 1
        sizes = np.array([len(p) for p in pieces[k:stop]])
        ends = np.cumsum(sizes)
        raw = np.frombuffer(b"".join(pieces[k:stop]), np.uint8)
        hasher = Hasher(raw)
        grams = hasher.grams(gram)
        least = sliding_argmin(grams, width - gram + 1)
        piece = np.repeat(np.arange(stop - k), sizes)[: len(least)]
        valid = np.arange(len(least)) + width <= ends[piece]
        at = np.flatnonzero(valid)
        run = np.concatenate(([True], (np.diff(least[at]) != 0) | (np.diff(piece[at]) != 0)))
        heads = np.flatnonzero(run)
        first, n = at[heads], np.diff(np.append(heads, len(at)))
        place = least[first]
        where = piece[first]
        begin = ends[where] - sizes[where]
        # the anchor's place in the segment is part of it: equal segments have equal windows at equal places
        joined = raw.tobytes()
        one, two = digests([joined[i:j] for i, j in zip(first.tolist(), (first + n + width - 1).tolist(), strict=True)])
        owners, shifts = np.array(owner[k:stop])[where], np.array(shift[k:stop])[where]
        one = one ^ ((place - first).astype(np.uint64) * BASE).view(np.int64)
        out.append((owners, grams[place], first - begin + shifts, n, np.stack((one, two), axis=1).view("V16")[:, 0]))
        k = stop
    if not out:
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, np.zeros(0, "V16")
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def common_prefixes(raw: np.ndarray, a: np.ndarray, b: np.ndarray, limit: np.ndarray) -> np.ndarray:
    """The lengths of the common prefixes of the suffixes at a and b, at most limit each."""
    out, left = limit.copy(), np.arange(len(a))
    step, done = 64, 0
    while len(left):
        for k in range(0, len(left), 4096):
            some = left[k : k + 4096]
            at = done + np.arange(step)
            last = len(raw) - 1
            differ = raw[np.minimum(a[some][:, None] + at, last)] != raw[np.minimum(b[some][:, None] + at, last)]
            found = differ.any(axis=1)
            out[some[found]] = np.minimum(limit[some[found]], done + differ[found].argmax(axis=1))
            left[k : k + 4096] = np.where(found | (limit[some] <= done + step), -1, some)
        left = left[left >= 0]
        done += step
    return out


def repeated_windows(segments: list[tuple[bytes, int]], width: int = WIDTH, sort: list[int] | None = None) -> list[np.ndarray]:
    """segments of (bytes, n): for each, which of its n windows (bytes i to i + width) also start elsewhere in these.

    sort: how many of the windows of each are put in the array, from the first on (all of them, if left out). The others are only
    known to repeat as far as the common prefixes of those that are in it reach.
    """
    text = b"".join(s + b"\0" for s, _ in segments)
    sizes = np.array([len(s) + 1 for s, _ in segments])
    starts = np.cumsum(sizes) - sizes
    ends = starts + sizes - 1  # the places between segments
    raw = np.frombuffer(text, np.uint8).astype(np.int16)
    total = len(raw)
    # a suffix ends with its segment, and an end is less than any byte: smaller[i] if suffix i is less than suffix i + 1
    step = np.zeros(total, np.int16)
    step[:-1] = raw[1:] - raw[:-1]
    step[ends - 1] = -256
    next_step = np.where(step != 0, np.arange(total), total)
    next_step = np.minimum(np.minimum.accumulate(next_step[::-1])[::-1], total - 1)
    smaller = step[next_step] > 0
    # the suffixes to sort: the windows, and after the last window of a segment what it takes to reach a smaller suffix
    edge = np.zeros(total + 1, np.int32)
    counts = np.array([n for _, n in segments] if sort is None else sort)
    edge[starts] += 1
    np.subtract.at(edge, starts + counts, 1)
    window = np.cumsum(edge[:-1]) > 0
    next_smaller = np.where(smaller, np.arange(total), total)
    next_smaller = np.minimum.accumulate(next_smaller[::-1])[::-1]
    last = starts + counts - 1
    reach = np.minimum(next_smaller[last], ends)  # its end where no smaller suffix follows
    edge = np.zeros(total + 1, np.int32)
    edge[starts] += 1
    np.subtract.at(edge, np.minimum(reach + 1, ends), 1)
    member = np.cumsum(edge[:-1]) > 0
    end_of = np.repeat(ends, sizes)
    # first stage: the smaller ones directly
    direct = np.flatnonzero(member & smaller)
    order = [i for _, i in sorted(zip([text[i:e] for i, e in zip(direct.tolist(), end_of[direct].tolist(), strict=True)], direct.tolist(), strict=True))]
    # buckets by first byte: larger suffixes to be induced at the front, the sorted ones at the back; segment ends first of all
    open_ends = ends[(reach == ends)].tolist()
    n_large = np.bincount(raw[member & ~smaller], minlength=256)
    n_small = np.bincount(raw[direct], minlength=256)
    front = len(open_ends) + np.concatenate(([0], np.cumsum(n_large + n_small)[:-1]))
    back = (front + n_large).tolist()
    front = front.tolist()
    array = [-1] * (len(open_ends) + int(member.sum()))
    array[: len(open_ends)] = open_ends
    for i in order:
        c = text[i]
        array[back[c]] = i
        back[c] += 1
    # second stage: a suffix that is larger than its successor takes the next place of its bucket when the scan meets that
    induce = (member & ~smaller).tobytes() + b"\0"
    for j in array:
        if j > 0 and induce[j - 1]:
            c = text[j - 1]
            array[front[c]] = j - 1
            front[c] += 1
    order = np.array(array, dtype=np.int64)
    order = order[window[order]]
    shared = common_prefixes(raw, order[:-1], order[1:], np.minimum(end_of[order[:-1]] - order[:-1], end_of[order[1:]] - order[1:]))
    longest = np.maximum(np.append(shared, 0), np.append(0, shared))
    hit = np.flatnonzero(longest >= width)
    edge = np.zeros(total + 1, np.int32)
    np.add.at(edge, order[hit], 1)
    np.subtract.at(edge, order[hit] + longest[hit] - width + 1, 1)
    flags = np.cumsum(edge[:-1]) > 0
    return [flags[s : s + n] for s, (_, n) in zip(starts.tolist(), segments, strict=True)]


KEYS = ["h", "fp1", "fp2"]  # of a segment: its anchor's hash and its digest
ROW = ["rk1", "rk2"]  # of a document: 128 bits of hash of all its columns


def anchor_rows(base: DataFrame, width: int, gram: int) -> DataFrame:
    """(rk1, rk2, text) -> (rk1, rk2, h, fp1, fp2, first, n, more): a row for each different segment of a text; more: where it
    stands after its first place, in ascending order (null: nowhere else)."""
    names = [*ROW, *KEYS, "first", "n", "more"]

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            owner, h, first, n, seg = anchors([t or b"" for t in as_bytes(b.column(2))], width, gram)
            one, two = np.ascontiguousarray(seg).view(np.int64).reshape(-1, 2).T
            # equal segments of a text side by side, in the order of their places
            order = np.lexsort((first, one, owner))
            owner, h, first, n, one, two = (c[order] for c in (owner, h.view(np.int64), first.astype(np.int32), n.astype(np.int32), one, two))
            new = np.ones(len(h) + 1, bool)
            new[1:-1] = (np.diff(owner) != 0) | (np.diff(h) != 0) | (np.diff(one) != 0) | (np.diff(two) != 0)
            at = np.flatnonzero(new)
            heads, again = at[:-1], np.diff(at) - 1
            offsets = np.concatenate(([0], np.cumsum(again))).astype(np.int32)
            more = pa.ListArray.from_arrays(pa.array(offsets), pa.array(first[~new[:-1]]), mask=pa.array(again == 0))
            rk1, rk2 = b.column(0).to_numpy()[owner[heads]], b.column(1).to_numpy()[owner[heads]]
            whole = pa.RecordBatch.from_arrays([*[pa.array(c) for c in (rk1, rk2, h[heads], one[heads], two[heads], first[heads], n[heads])], more], names=names)
            for k in range(0, len(heads), 1 << 16):
                yield whole.slice(k, 1 << 16)

    return base.select(*ROW, "text").mapInArrow(tidy(run), "rk1 long, rk2 long, h long, fp1 long, fp2 long, first int, n int, more array<int>")


CUT = "h long, fp1 long, fp2 long, m long, block int, blocks int, n int, role int, full boolean, data binary"
CUT_ARROW = pa.schema([("h", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("m", pa.int64()), ("block", pa.int32()), ("blocks", pa.int32()), ("n", pa.int32()), ("role", pa.int32()), ("full", pa.bool_()), ("data", pa.binary())])


def cut_segments(rows: DataFrame, width: int) -> DataFrame:
    """(text, want) -> the wanted segments with their bytes"""
    names = [n for n in CUT_ARROW.names if n != "data"]

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            for b in blocks:
                for text, want in zip(as_bytes(b.column(0)), b.column(1).to_pylist(), strict=True):
                    for w in want:
                        yield (*(w[n] for n in names), text[w["first"] : w["first"] + w["n"] + width - 1])

        yield from batches(out(), CUT_ARROW)

    return rows.select("text", "want").mapInArrow(tidy(run), CUT)


def sorted_segments(segs: DataFrame, width: int) -> DataFrame:
    """Segments in the order of (h, block, fp, role) -> (h, fp1, fp2, m, lo, hi, block, d1, d2).

    Rows with m = 1 and no digest are runs of repeated windows; those with m > 1 are segments of which the array did not
    find a copy. Rows with a digest are windows of anchors whose segments went to several arrays: one row for equal windows of an array.
    """
    schema = pa.schema([("h", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("m", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32()), ("block", pa.int32()), ("d1", pa.int64()), ("d2", pa.int64())])

    def solve(held: list[tuple]) -> Iterator[tuple]:
        told: set[tuple[int, int, int]] = set()
        flagged = repeated_windows([(s[9], s[6]) for s in held], width, [s[6] if s[8] else 1 for s in held])
        for (h, fp1, fp2, m, block, blocks, n, role, full, data), flags in zip(held, flagged, strict=True):
            if m > 1 and role == 0 and not flags.all():
                yield h, fp1, fp2, m, 0, n, block, None, None
            elif m == 1:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
                for lo, hi in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                    yield h, fp1, fp2, m, lo, hi, block, None, None
            if blocks > 1 and full:
                for k, (d1, d2) in enumerate(zip(*(d.tolist() for d in digests([data[i : i + width] for i in range(n)])), strict=True)):
                    if (h, d1, d2) not in told:
                        told.add((h, d1, d2))
                        yield h, fp1, fp2, m, k, k + 1, block, d1, d2

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            held: list[tuple] = []
            size, array, one = 0, None, None
            for b in blocks:
                for s in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if (s[:3], s[7]) == one:
                        continue  # rows that are equal in all columns cut the same segment
                    if size >= ARRAY_BYTES and (s[0], s[4]) != array:
                        yield from solve(held)
                        held, size = [], 0
                    array, one = (s[0], s[4]), (s[:3], s[7])
                    held.append(s)
                    size += len(s[9])
            if held:
                yield from solve(held)

        yield from batches(out(), schema)

    return segs.mapInArrow(tidy(run), "h long, fp1 long, fp2 long, m long, lo int, hi int, block int, d1 long, d2 long")


def through_arrays(base: DataFrame, todo: DataFrame, width: int, name: str) -> DataFrame:
    """todo(h, fp1, fp2, m, full, block, blocks, a, b): segments at the place a and, with copies, b, a struct (rk1, rk2, first, n)."""
    rep = lambda role, at, full: F.struct(F.lit(role).alias("role"), full.alias("full"), F.col(at).alias("at"))
    reps = F.when(F.col("m") > 1, F.array(rep(0, "a", F.col("full")), rep(1, "b", F.lit(False)))).otherwise(F.array(rep(0, "a", F.col("full"))))
    each = todo.select(*KEYS, "m", "block", "blocks", F.explode(reps).alias("r")).select(*KEYS, "m", "block", "blocks", "r.role", "r.full", "r.at.*")
    want = each.groupBy(*ROW).agg(F.collect_list(F.struct(*KEYS, "m", "block", "blocks", "n", "role", "full", "first")).alias("want"))
    segs = cut_segments(base.join(want, ROW), width)
    return written(sorted_segments(segs.repartition("h", "block").sortWithinPartitions("h", "block", "fp1", "fp2", "role"), width), name)


def repeated_spans(base: DataFrame, width: int = WIDTH, gram: int = GRAM, block: int | None = None) -> DataFrame:
    """(rk1, rk2, text[, ...]) -> (rk1, rk2, spans array<struct<lo, hi>>): byte ranges that repeated windows cover; not merged."""
    found = anchor_rows(base, width, gram)
    # partial aggregates; an anchor or a segment in a third of all documents is one row a task
    places = F.when(F.col("more").isNull(), 1).otherwise(F.size("more") + 1)
    copies = written(found.groupBy(*KEYS).agg(F.sum(places).alias("m")), "segment-counts")
    per = copies.groupBy("h").agg(F.sum("m").alias("c"), F.count(F.lit(1)).alias("k"), F.min("m").alias("least")).where("c > 1")
    # segments of anchors that occur twice; full: some of its anchor's segments have no copy and differ from others
    known = copies.join(per, "h").select(*KEYS, "m", "k", ((F.col("k") > 1) & (F.col("least") == 1)).alias("full"))
    known = written(known, "repeated-segments")  # a plain exchange on either side of the join lets a hot segment be split
    dup = written(found.join(known, KEYS), "repeated-anchors")
    # each different segment once, with two of its places
    place = lambda at: F.struct(*ROW, at.alias("first"), "n")
    last = F.coalesce(F.element_at("more", -1), "first")
    todo = dup.groupBy(*KEYS, "m", "k", "full").agg(F.min(place(F.col("first"))).alias("a"), F.max(place(last)).alias("b"))
    blocks = F.ceil(F.col("k") / F.lit(block or BLOCK)).cast("int")
    todo = written(todo.withColumn("blocks", blocks).withColumn("block", F.pmod("fp1", F.col("blocks")).cast("int")), "segments")
    solved = through_arrays(base, todo, width, "repeated-windows")
    runs = solved.where("d1 is null and m = 1").select(*KEYS, "lo", "hi")
    if todo.where("blocks > 1 and full").limit(1).count():
        # windows of anchors with several arrays: of windows of two arrays with equal digests, two go through an array of their own
        windows = solved.where("d1 is not null")
        at = F.struct("block", *KEYS[1:], "lo")
        far = windows.groupBy("h", "d1", "d2").agg(F.min(at).alias("a"), F.max(at).alias("b")).where("a.block <> b.block")
        ends = far.select("h", "d1", "d2", F.explode(F.array("a", "b")).alias("e")).select("h", "d1", "d2", "e.fp1", "e.fp2", "e.lo")
        ends = ends.join(todo.select(*KEYS, "a"), KEYS).groupBy("h", "d1", "d2").agg(*[f(F.struct("a.rk1", "a.rk2", (F.col("a.first") + F.col("lo")).alias("first"), F.lit(1).alias("n"))).alias(n) for f, n in ((F.min, "a"), (F.max, "b"))])
        pairs = written(ends.select("h", F.col("d1").alias("fp1"), F.col("d2").alias("fp2"), F.lit(2).cast("long").alias("m"), F.lit(False).alias("full"), F.lit(0).alias("block"), F.lit(1).alias("blocks"), "a", "b"), "far-windows")
        unlike = written(through_arrays(base, pairs, width, "far-arrays").where("m > 1").select("h", F.col("fp1").alias("d1"), F.col("fp2").alias("d2")), "far-unlike")
        alike = pairs.select("h", F.col("fp1").alias("d1"), F.col("fp2").alias("d2")).join(unlike, ["h", "d1", "d2"], "left_anti")
        runs = runs.unionByName(windows.where("m = 1").join(alike, ["h", "d1", "d2"]).select(*KEYS, "lo", "hi"))
    single = runs.join(todo.where("m = 1").select(*KEYS, "a"), KEYS).select("a.rk1", "a.rk2", (F.col("a.first") + F.col("lo")).alias("lo"), (F.col("a.first") + F.col("hi") - 1 + width).alias("hi"))
    # segments with copies go but where the array found none; that table is small (as a rule empty), and a large one is joined by sorting
    refuted = written(solved.where("m > 1 and d1 is null").select(*KEYS).distinct(), "refuted")
    firsts = F.when(F.col("more").isNull(), F.array("first")).otherwise(F.concat(F.array("first"), "more"))
    whole = F.transform(firsts, lambda at: F.struct(at.alias("lo"), (at + F.col("n") - 1 + width).alias("hi")))
    spans = dup.where("m > 1").join(refuted, KEYS, "left_anti").select(*ROW, whole.alias("s")).unionByName(single.select(*ROW, F.array(F.struct("lo", "hi")).alias("s")))
    return spans.groupBy(*ROW).agg(F.flatten(F.collect_set("s")).alias("spans"))


def remove_repeats(docs: DataFrame, text_col: str = "text", width: int = WIDTH, gram: int = GRAM, block: int | None = None, as_text: bool = False) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept appended (replaced, if docs has them).

    kept is what is left of the text's UTF-8 bytes without each byte that a repeated string of `width` bytes covers; with
    as_text a string, in which characters that a cut has split are left out. A null text counts as empty (kept is then
    empty); texts shorter than `width` keep all. Rows of one id and repeated rows are documents of their own, so the
    long texts of repeated rows are removed whole.
    """
    arrow_limits(docs.sparkSession)
    extra = {"n_bytes": T.LongType(), "n_removed": T.LongType(), "n_spans": T.LongType(), "kept": T.StringType() if as_text else T.BinaryType()}
    kept = [f for f in docs.schema.fields if f.name not in extra]
    at = [f.name for f in kept].index(text_col)
    # columns have names of our own meanwhile, whatever theirs are
    inner = ["text" if i == at else f"c{i}" for i in range(len(kept))]
    base = docs.select(*[F.col(f"`{f.name}`").alias(c) for f, c in zip(kept, inner, strict=True)])
    ids = [F.col(c) for f, c in zip(kept, inner, strict=True) if c != "text" and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    base = base.select(*inner, F.xxhash64(F.col("text").isNull(), "text", *ids).alias("rk1"), F.xxhash64(F.lit("second"), F.col("text").isNull(), "text", *ids).alias("rk2"))
    joined = base.join(repeated_spans(base, width, gram, block), ROW, "left").select(*inner, "spans")
    schema = T.StructType([*kept, *[T.StructField(n, t) for n, t in extra.items()]])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            rows = []
            for text, spans in zip(as_bytes(b.column(at)), b.column(len(kept)).to_pylist(), strict=True):
                text, out, end, removed, n = text or b"", [], 0, 0, 0
                for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
                    if lo > end or not n:
                        out.append(text[end:lo])
                        n += 1
                        end = lo
                    removed += max(0, hi - end)
                    end = max(end, hi)
                out.append(text[end:])
                whole = b"".join(out)
                rows.append((len(text), removed, n, whole.decode("utf-8", "ignore") if as_text else whole))
            cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string() if as_text else pa.binary()], strict=True)]], names=schema.names)

    return joined.mapInArrow(tidy(run), schema)


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
