"""Benchmark decontamination over a distributed positional inverted index.

The index is a table of segments in the shared folder. A segment holds the postings of some whole documents: its terms
in hash order, how often each occurs, and for each term the ascending places (word numbers within the segment) where it
stands; and where each document begins. Every word of every document is in it, whatever the benchmark.

A phrase is looked up segment by segment: its terms' lists are shifted by their offsets in the phrase and intersected
from the rarest term on, so frequent terms are only probed at the few places that are left. Lists never travel and no
term's list is gathered in one task, so a term or passage in a third of all documents is spread like the documents.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, as_bytes, batches, tidy, work_dir

#: Bytes outside words become spaces, A-Z become a-z; bytes of characters beyond ASCII are word bytes.
FOLD = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
CHUNK = 1 << 20
SEGMENT_BYTES = 6 << 20
QUERY_WINDOWS = 250_000


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


class Powers:
    """Powers of BASE and of its inverse, as long as asked for so far."""

    def __init__(self):
        self.n, self.up, self.down = 0, np.ones(0, np.uint64), np.ones(0, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = max(n, CHUNK + 4096)
            for name, base in (("up", BASE), ("down", INVERSE)):
                p = np.full(self.n, base, np.uint64)
                p[0] = 1
                setattr(self, name, np.multiply.accumulate(p))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def spans(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First byte and byte after the last of each run without a space."""
    edge = np.diff(np.concatenate(([0], (raw != 0x20).view(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word of a buffer. It orders words; that equal hashes are equal words is looked up in their bytes."""
    out = np.empty(len(starts), np.uint64)
    k = 0
    while k < len(starts):
        first = int(starts[k])
        stop = max(k + 1, int(np.searchsorted(ends, first + CHUNK, "right")))
        part = raw[first : int(ends[stop - 1])]
        up, down = POWERS.get(len(part) + 1)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part * up[: len(part)], out=sums[1:])
        s, e = starts[k:stop] - first, ends[k:stop] - first
        out[k:stop] = (sums[e] - sums[s]) * down[s]
        k = stop
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return out


def pieces(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> bytes:
    """The given spans of raw, each followed by one space."""
    n = ends - starts + 1
    at = np.repeat(starts - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))
    return np.append(raw, np.uint8(0x20))[at].tobytes()


def unlike(raw: np.ndarray, starts: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the words a differ from the words b, byte for byte: eight bytes of all at a time."""
    out = sizes[a] != sizes[b]
    eights = np.lib.stride_tricks.sliding_window_view(np.concatenate((raw, np.zeros(8, np.uint8))), 8)
    left, at = np.flatnonzero(~out), 0
    while len(left):
        rest = np.minimum(sizes[a[left]] - at, 8)
        differ = ((eights[starts[a[left]] + at] != eights[starts[b[left]] + at]) & (np.arange(8) < rest[:, None])).any(axis=1)
        out[left] = differ
        left = left[~differ & (sizes[a[left]] > at + 8)]
        at += 8
    return out


class Segment:
    """Terms in hash order with their postings, and the documents' first places."""

    def __init__(self, terms: list[bytes], ends: np.ndarray, places: np.ndarray, firsts: np.ndarray, n_words: int):
        self.ends, self.places, self.firsts, self.n_words = ends, places, firsts, n_words
        self.number = {t: i for i, t in enumerate(terms)}

    @staticmethod
    def build(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, int]:
        """(terms joined by spaces, ends of their lists, places, first place of each document, number of words)"""
        joined = b" ".join(t.translate(FOLD) for t in texts) + b" "
        raw = np.frombuffer(joined, np.uint8)
        starts, ends = spans(raw)
        begin = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])[:-1]))
        firsts = np.searchsorted(starts, begin)
        n = len(starts)
        if not n:
            return b"", np.zeros(0, np.int64), np.zeros(0, np.int64), firsts, 0
        h = hashes(raw, starts, ends)
        bits = np.uint64(max(1, n.bit_length()))
        low = (np.uint64(1) << bits) - np.uint64(1)
        places = (np.sort((h & ~low) | np.arange(n, dtype=np.uint64)) & low).astype(np.int64)
        sorted_h = h[places]
        new = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
        # the upper bits alone were sorted: where they do not tell two hashes apart, sort by all bits
        if int(new.sum()) != 1 + int(np.count_nonzero(np.diff(sorted_h & ~low))):
            places = np.argsort(h, kind="stable")
            sorted_h = h[places]
            new = np.concatenate(([True], sorted_h[1:] != sorted_h[:-1]))
        same = np.flatnonzero(~new[1:])
        differ = same[unlike(raw, starts, ends - starts, places[same], places[same + 1])]
        if len(differ):
            # words of one hash that differ: each such hash's places are put in the order of their words
            run = np.append(np.flatnonzero(new), n)
            for g in np.unique(np.searchsorted(run, differ, "right") - 1).tolist():
                lo, hi = int(run[g]), int(run[g + 1])
                by_word: dict[bytes, list[int]] = {}
                for i in sorted(places[lo:hi].tolist()):
                    by_word.setdefault(joined[starts[i] : ends[i]], []).append(i)
                places[lo:hi] = [i for held in by_word.values() for i in held]
                at = lo
                for held in by_word.values():
                    new[at] = True
                    at += len(held)
        heads = np.flatnonzero(new)
        one = places[heads]
        return pieces(raw, starts[one], ends[one]), np.append(heads[1:], n), places, firsts, n

    def postings(self, term: bytes) -> np.ndarray:
        i = self.number.get(term)
        return self.places[:0] if i is None else self.places[self.ends[i - 1] if i else 0 : self.ends[i]]

    def same_document(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, first, "right") == np.searchsorted(self.firsts, last, "right")

    def phrase(self, terms: list[bytes]) -> np.ndarray:
        """Places where terms stand one after the other within a document."""
        lists = [self.postings(t) for t in terms]
        order = sorted(range(len(terms)), key=lambda i: len(lists[i]))
        if not len(lists[order[0]]):
            return self.places[:0]
        left = lists[order[0]] - order[0]
        for i in order[1:]:
            at = np.searchsorted(lists[i], left + i)
            at[at == len(lists[i])] = 0
            left = left[lists[i][at] == left + i]
            if not len(left):
                return left
        return left[(left >= 0) & self.same_document(left, left + len(terms) - 1)]

    def near(self, terms: list[bytes], span: int) -> list[tuple[int, int]]:
        """Shortest stretches (first, last place) of at most span words within a document that hold all terms."""
        wanted = sorted(set(terms), key=lambda t: len(self.postings(t)))
        lists = [self.postings(t) for t in wanted]
        if not wanted or not len(lists[0]):
            return []
        # places of the rarest term that have each other term, from the rarer on, less than span words away
        left = lists[0]
        for q in lists[1:]:
            at = np.searchsorted(q, left - span + 1)
            left = left[(at < len(q)) & (q[np.minimum(at, len(q) - 1)] < left + span)]
        found = set()
        for p in left.tolist():
            around = sorted((int(x), k) for k, q in enumerate(lists) for x in q[np.searchsorted(q, p - span + 1) : np.searchsorted(q, p + span)])
            seen: dict[int, int] = {}
            for x, k in around:
                seen[k] = x
                if len(seen) == len(lists):
                    first = min(seen.values())
                    if first <= p <= x and x - first < span and self.same_document(np.array([first]), np.array([x]))[0]:
                        found.add((first, x))
        # of stretches in the order of their ends, one holds another if that begins no earlier and ends no later
        out: list[tuple[int, int]] = []
        for a, b in sorted(found, key=lambda f: (f[1], -f[0])):
            if not out or a > out[-1][0]:
                out.append((a, b))
        return out


INDEX = "seg string, doc_ids array<bigint>, crcs array<bigint>, terms binary, ends binary, places binary, firsts binary, n_words bigint"


def write_index(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Index every word of every text (null: no words) at path. A segment holds about SEGMENT_BYTES of whole texts."""
    arrow_limits(docs.sparkSession)
    types = [pa.string()] + [pa.list_(pa.int64())] * 2 + [pa.binary()] * 4 + [pa.int64()]
    names = [c.split()[0] for c in INDEX.split(", ")]

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, ids, texts = TaskContext.get().partitionId(), [], []
        held = nr = 0

        def flush() -> pa.RecordBatch:
            terms, ends, places, firsts, n = Segment.build(texts)
            row = (f"{part}-{nr}", ids, [zlib.crc32(t) for t in texts], terms, ends.astype("<u4").tobytes(), places.astype("<u4").tobytes(), firsts.astype("<u4").tobytes(), n)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names)

        for b in blocks:
            for key, text in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                ids.append(key)
                texts.append(text or b"")
                held += len(texts[-1])
                if held >= SEGMENT_BYTES:
                    yield flush()
                    ids, texts, held, nr = [], [], 0, nr + 1
        if ids:
            yield flush()

    docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).mapInArrow(tidy(run), INDEX).write.option("compression", "lz4_raw").parquet(path)


def segments(blocks: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, list, list, Segment]]:
    for b in blocks:
        for name, ids, crcs, terms, ends, places, firsts, n in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
            yield name, ids, crcs, Segment(terms.split(b" ")[:-1], np.frombuffer(ends, "<u4").astype(np.int64), np.frombuffer(places, "<u4").astype(np.int64), np.frombuffer(firsts, "<u4").astype(np.int64), n)


def windows(text: bytes | None, width: int) -> set[tuple[bytes, ...]]:
    w = words(text)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


class Windows:
    """Windows of test items as rows of term numbers, with the ids of the items that have each."""

    def __init__(self, block: dict[tuple[bytes, ...], list[str]]):
        number: dict[bytes, int] = {}
        width = max(map(len, block), default=1)
        self.rows = np.full((len(block), width), -1, np.int32)
        for i, w in enumerate(block):
            self.rows[i, : len(w)] = [number.setdefault(t, len(number)) for t in w]
        self.terms, self.items = list(number), list(block.values())

    def within(self, seg: Segment) -> Iterator[tuple[list[bytes], list[str]]]:
        """(terms, items) of the windows all of whose terms the segment has."""
        here = np.array([*(t in seg.number for t in self.terms), True])  # the last is what -1 finds
        for i in np.flatnonzero(here[self.rows].all(axis=1)).tolist():
            yield [self.terms[t] for t in self.rows[i].tolist() if t >= 0], self.items[i]


def query_blocks(items: DataFrame, width: int, id_col: str, text_col: str, limit: int) -> Iterator[Windows]:
    """Windows in blocks of about `limit`: the driver and each task hold one block at a time."""
    block: dict[tuple[bytes, ...], list[str]] = {}
    for r in items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("k"), F.col(text_col).cast("binary").alias("t")).toLocalIterator():
        for w in windows(bytes(r["t"]) if r["t"] is not None else None, width):
            block.setdefault(w, []).append(r["k"])
        if len(block) >= limit:
            yield Windows(block)
            block = {}
    yield Windows(block)


def n_covered(hits: list[dict]) -> int:
    """How many words the hits cover."""
    end = total = 0
    for h in sorted(hits, key=lambda h: h["first"]):
        stop = h["first"] + h["n"]
        total += max(0, stop - max(end, h["first"]))
        end = max(end, stop)
    return total


HITS = "seg string, nr int, doc_id long, crc long, n_words long, hits array<struct<first:int,n:int>>, items array<string>"
HITS_ARROW = pa.schema([("seg", pa.string()), ("nr", pa.int32()), ("doc_id", pa.int64()), ("crc", pa.int64()), ("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32())]))), ("items", pa.list_(pa.string()))])
DIGEST = "doc_id long, crc long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
DIGEST_ARROW = pa.schema([("doc_id", pa.int64()), ("crc", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def digest(seg: str, nr: int, doc_id: int, crc: int, n_words: int, hits: list[dict], items: list[str]) -> tuple:
    n = n_covered(hits)
    return doc_id, crc, n_words, n, len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), n > 0


def scan(spark: SparkSession, path: str, items: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text", limit: int = QUERY_WINDOWS, digests: bool = False) -> DataFrame:
    """One row a document: doc_id, crc (of its text), n_words, hits (array of first word and number of words), items (array);
    or, with digests, the columns of contamination()."""
    arrow_limits(spark)
    table = spark.read.schema(INDEX).parquet(path)
    parts: list[DataFrame] = []

    def look_up(block: Windows, at_once: bool) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for name, ids, crcs, seg in segments(blocks):
                    hits: dict[int, list] = {}
                    of: dict[int, set] = {}
                    for terms, names in shared.value.within(seg):
                        for p in seg.phrase(terms).tolist():
                            d = int(np.searchsorted(seg.firsts, p, "right")) - 1
                            hits.setdefault(d, []).append({"first": p - int(seg.firsts[d]), "n": len(terms)})
                            of.setdefault(d, set()).update(names)
                    sizes = np.diff(np.append(seg.firsts, seg.n_words)).tolist()
                    for d, (key, crc, n) in enumerate(zip(ids, crcs, sizes, strict=True)):
                        row = (name, d, key, crc, n, hits.get(d, []), sorted(of.get(d, ())))
                        yield digest(*row) if at_once else row

            yield from batches(rows(), DIGEST_ARROW if at_once else HITS_ARROW, 2048)

        return table.mapInArrow(tidy(run), DIGEST if at_once else HITS)

    blocks = query_blocks(items, width, id_col, text_col, limit)
    now, after = next(blocks), next(blocks, None)
    if not after and digests:
        return look_up(now, True)
    parts.append(look_up(now, False))
    while after:
        parts.append(look_up(after, False))
        after = next(blocks, None)
    result = parts[0]
    if len(parts) > 1:
        for part in parts[1:]:
            result = result.unionByName(part)
        # a document's rows of the blocks meet
        result = result.groupBy("seg", "nr", "doc_id", "crc", "n_words").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    if not digests:
        return result.drop("seg", "nr")

    def finish(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches((digest(*r) for b in rows for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), DIGEST_ARROW, 2048)

    return result.select(*HITS_ARROW.names).mapInArrow(tidy(finish), DIGEST)


def near_matches(spark: SparkSession, path: str, queries: list[list[str]], span: int) -> DataFrame:
    """Proximity: (query, doc_id, first, last) for the shortest stretches of at most span words that hold all words of a query."""
    asked = [[w for part in q for w in words(part.encode())] for q in queries]
    arrow = pa.schema([("query", pa.int32()), ("doc_id", pa.int64()), ("first", pa.int32()), ("last", pa.int32())])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for _, ids, _, seg in segments(blocks):
                for k, terms in enumerate(asked):
                    for a, b in seg.near(terms, span):
                        d = int(np.searchsorted(seg.firsts, a, "right")) - 1
                        yield k, ids[d], a - int(seg.firsts[d]), b - int(seg.firsts[d])

        yield from batches(rows(), arrow)

    arrow_limits(spark)
    return spark.read.schema(INDEX).parquet(path).mapInArrow(tidy(run), "query int, doc_id long, first int, last int")


def near_items(docs: DataFrame, items: DataFrame, width: int = 10, span: int = 20, limit: int = QUERY_WINDOWS) -> DataFrame:
    """(doc_id, item_id, n_near, first, last), a row for each document and item with a proximity match.

    A match is a shortest stretch of at most span words of a document that holds all words of a window of the item, in any
    order; n_near counts the different stretches of all the item's windows, first and last are the word numbers of the first of
    them. Ids of items are strings, as in contamination(); documents that are repeated give a row each.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "postings")
    write_index(docs, path)
    table = spark.read.schema(INDEX).parquet(path)
    schema = pa.schema([("seg", pa.string()), ("nr", pa.int64()), ("doc_id", pa.int64()), ("item_id", pa.string()), ("first", pa.int64()), ("last", pa.int64())])
    found = None
    for block in query_blocks(items, width, "item_id", "text", limit):
        shared = spark.sparkContext.broadcast(block)

        def run(blocks: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                for name, ids, _, seg in segments(blocks):
                    for terms, names in shared.value.within(seg):
                        for a, b in seg.near(terms, span):
                            d = int(np.searchsorted(seg.firsts, a, "right")) - 1
                            for item in set(names):
                                yield name, d, ids[d], item, a - int(seg.firsts[d]), b - int(seg.firsts[d])

            yield from batches(rows(), schema)

        part = table.mapInArrow(tidy(run), "seg string, nr long, doc_id long, item_id string, first long, last long")
        found = part if found is None else found.unionByName(part)
    stretches = found.distinct().groupBy("seg", "nr", "doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct("first", "last")).alias("at"))
    return stretches.select("doc_id", "item_id", "n_near", "at.first", "at.last")


def contamination(docs: DataFrame, items: DataFrame, width: int = 10) -> DataFrame:
    """One row a document: doc_id, crc, n_words, n_hit, n_items, items_sha256, contaminated.

    A hit word lies inside an occurrence of a window of `width` consecutive words of an item (the whole item if it has
    fewer, but not none). Null and wordless texts have no words and no hits; wordless items have no window. Items of one
    id are one item; a null item id counts as the item "null". Rows of one doc_id and repeated rows each give a row.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "postings")
    write_index(docs, path)
    return scan(spark, path, items, width, digests=True)


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).drop("crc")


def decontaminate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return near_items(docs, items)
