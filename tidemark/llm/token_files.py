"""Token-ID output: a concatenated id array with Elias-Fano coded document boundaries.

One container holds the ids of consecutive documents and their boundaries. Boundaries are a non-decreasing sequence, so
they take about 2 + log2(ids / documents) bits each: the low bits packed side by side, the high parts in unary, and a
sampled select directory over the unary bits (32-bit word numbers; there is no table of 64-bit offsets). The containers
are rows of a Parquet table in the shared folder, which Spark's own committer writes, so a lost executor's half-written
output is never read.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, as_bytes, tidy, work_dir

MAGIC = b"EFT1"
HEADER = struct.Struct("<4sBBxxIQQII")  # magic, bytes an id, low bits, documents, ids, bytes of low part, words of high part, samples
SAMPLE = 256
SPACES = bytes(0x20 if b in b" \t\n\r\x0b\x0c" else b for b in range(256))
MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
POPCOUNT = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def pack_bits(values: np.ndarray, width: int) -> bytes:
    """values (each below 2**width) side by side, little-endian bit order."""
    if not width or not len(values):
        return b""
    bits = (values[:, None] >> np.arange(width, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(bits.astype(np.uint8).reshape(-1), bitorder="little").tobytes()


def unpack_bits(data: bytes, width: int, n: int) -> np.ndarray:
    if not width or not n:
        return np.zeros(n, dtype=np.uint64)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little")[: n * width].reshape(n, width)
    return bits.astype(np.uint64) @ (np.uint64(1) << np.arange(width, dtype=np.uint64))


class EliasFano:
    """A non-decreasing sequence with select; `get(i)` reads one value without decoding the others."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, dtype=np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        low_bits = max(0, int(top // max(n, 1)).bit_length() - 1)
        parts = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
        high = np.zeros((int(parts[-1]) // 64 + 1) * 64 if n else 0, dtype=np.uint8)
        high[parts] = 1
        samples = parts[::SAMPLE].astype(np.uint32)
        return cls(n, low_bits, pack_bits(values & np.uint64((1 << low_bits) - 1), low_bits), np.packbits(high, bitorder="little"), samples)

    def select(self, i: int) -> int:
        """The place of the i-th one in the unary part: from the nearest sample on, byte by byte."""
        place, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = place >> 3
        cell = int(self.high[byte]) & (0xFF << (place & 7))
        while left >= POPCOUNT[cell]:
            left -= int(POPCOUNT[cell])
            byte += 1
            cell = int(self.high[byte])
        for _ in range(left):
            cell &= cell - 1
        return byte * 8 + (cell & -cell).bit_length() - 1

    def get(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = (self.select(i) - i) << self.low_bits
        if self.low_bits:
            first = i * self.low_bits
            raw = int.from_bytes(self.low[first // 8 : (first + self.low_bits + 7) // 8], "little")
            value |= (raw >> (first % 8)) & ((1 << self.low_bits) - 1)
        return value

    def all(self) -> np.ndarray:
        places = np.flatnonzero(np.unpackbits(self.high, bitorder="little")).astype(np.int64)
        return ((places - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)) | unpack_bits(self.low, self.low_bits, self.n)


def to_container(ids: bytes, ends: np.ndarray) -> bytes:
    """ids: little-endian unsigned 32-bit; ends: ids up to and with each document. Ids below 2**16 are stored in two bytes."""
    flat = np.frombuffer(ids, "<u4")
    width = 2 if not len(flat) or int(flat.max()) < 1 << 16 else 4
    ef = EliasFano.of(ends)
    head = HEADER.pack(MAGIC, width, ef.low_bits, len(ends), len(flat), len(ef.low), len(ef.high), len(ef.samples))
    return b"".join((head, ef.samples.astype("<u4").tobytes(), ef.high.tobytes(), ef.low, flat.astype(f"<u{width}").tobytes()))


class Container:
    """Random access to the documents of one container."""

    def __init__(self, data: bytes):
        magic, width, low_bits, self.n_docs, self.n_ids, n_low, n_high, n_samples = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a token container")
        at = HEADER.size
        samples = np.frombuffer(data, "<u4", n_samples, at)
        at += 4 * n_samples
        high = np.frombuffer(data, np.uint8, n_high, at)
        at += n_high
        self.ends = EliasFano(self.n_docs, low_bits, data[at : at + n_low], high, samples)
        self.ids = np.frombuffer(data, f"<u{width}", self.n_ids, at + n_low)

    def document(self, i: int) -> np.ndarray:
        return self.ids[self.ends.get(i - 1) if i else 0 : self.ends.get(i)].astype(np.uint32)


class WordCache:
    """Token ids of pieces between ASCII white space, each encoded once by the library.

    The normalizer and the pre-tokenizer of a vocabulary that drops white space never join text across it, so a text's
    ids are those of its pieces in order. A batch of texts is cut into pieces as arrays; pieces of up to 16 bytes are
    two 64-bit numbers, which makes finding the different ones and those already known exact and cheap. New pieces go to
    the library in long lines; longer pieces and those with special tokens are kept in a dictionary. When more than
    `limit` pieces or `limit_bytes` bytes of them or of their ids are known, those met least recently go.
    """

    def __init__(self, path: str, limit: int = 1_000_000, limit_bytes: int = 48 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        added = self.tokenizer.get_added_tokens_decoder()
        self.part_id, token = min(added.items())
        self.part, self.specials = token.content.encode(), [t.content.encode() for t in added.values()]
        suffix = json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix")
        self.word_end = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)
        if suffix:
            self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        self.limit, self.limit_bytes, self.now = limit, limit_bytes, 0
        self.clear()

    def clear(self) -> None:
        """h: hash, in order; a, b, n: the piece; start, count: its place in the pool of ids; used: the last batch with it."""
        self.h, self.a, self.b = (np.zeros(0, np.uint64) for _ in range(3))
        self.n, self.start, self.count, self.used = (np.zeros(0, np.int64) for _ in range(4))
        self.pool, self.long, self.long_bytes = np.zeros(0, np.uint32), {}, 0
        (self.dot, self.comma), _ = self.encode_new([b".", b","])

    def ids_of(self, line: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([line.decode("utf-8", "replace")], add_special_tokens=False)[0].ids, np.uint32)

    def encode_new(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) in the pool of each word; none has a special token. Words of ASCII letters alone, lower-cased,
        end at the one token with the end-of-word mark; others are parted by a special token."""
        start, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        simple = [i for i, w in enumerate(words) if w.isalpha()] if self.word_end.any() else []
        other = [i for i, w in enumerate(words) if not w.isalpha()] if simple else list(range(len(words)))
        end, made = len(self.pool), [self.pool]
        for places, gap, marks in ((simple, b" ", True), (other, self.part, False)):
            for k in range(0, len(places), 512):
                at = np.array(places[k : k + 512])
                ids = self.ids_of(gap.join([words[i] for i in at.tolist()]))
                cuts = np.flatnonzero(self.word_end[ids]) + 1 if marks else np.append(np.flatnonzero(ids == self.part_id), len(ids))
                if len(cuts) != len(at):
                    raise ValueError("the vocabulary does not part text as expected")
                first = np.concatenate(([0], cuts[:-1] + (0 if marks else 1)))
                start[at], count[at] = end + first, cuts - first
                end += len(ids)
                made.append(ids)
        self.pool = np.concatenate(made)
        return start, count

    def forget(self) -> None:
        """Keep the half met most recently; ids move together."""
        keep = self.used > np.partition(self.used, len(self.used) // 2)[len(self.used) // 2]
        fields = {k: getattr(self, k)[keep] for k in ("h", "a", "b", "n", "start", "count", "used")}
        old = self.pool
        self.clear()
        ids = old[np.repeat(fields["start"] - np.cumsum(fields["count"]) + fields["count"], fields["count"]) + np.arange(int(fields["count"].sum()))]
        fields["start"] = np.cumsum(fields["count"]) - fields["count"] + len(self.pool)
        self.pool = np.concatenate((self.pool, ids))
        for k, v in fields.items():
            setattr(self, k, v)

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        if not texts:
            return []
        self.now += 1
        if len(self.h) > self.limit or len(self.long) > self.limit // 8 or max(self.long_bytes, self.pool.nbytes) > self.limit_bytes:
            self.forget()
        sizes = np.array([len(t) + 1 if t else 1 for t in texts])
        joined = b" ".join([t or b"" for t in texts]).translate(SPACES) + b" "
        raw = np.frombuffer(joined + bytes(16), np.uint8)
        blank = np.frombuffer(joined, np.uint8) == 0x20
        edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
        if len(blank) and not blank[0]:
            edge = np.concatenate(([0], edge))
        starts, ends = edge[::2], edge[1::2]
        canon, plain = raw.copy(), np.ones(len(starts), bool)
        high = np.flatnonzero(raw >= 128)
        plain[np.searchsorted(starts, high, "right") - 1] = False
        special = np.zeros(len(starts), bool)
        if b"<|" in joined or any(t in joined for t in self.specials):
            for i, (x, y) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
                special[i] = b"<|" in (w := joined[x:y]) or any(t in w for t in self.specials)
            plain &= ~special
        # the normalizer lower-cases; doing so before is the same for pieces of ASCII
        upper = np.flatnonzero((raw >= 65) & (raw <= 90))
        upper = upper[plain[np.searchsorted(starts, upper, "right") - 1]]
        canon[upper] += 32
        # the pattern always cuts between a letter and one final stop or comma
        last, before = canon[ends - 1], canon[ends - 2]
        tail = plain & (ends - starts > 1) & ((last == 46) | (last == 44)) & (before >= 97) & (before <= 122)
        ends = ends - tail
        n = ends - starts
        start, count = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        short = np.flatnonzero((n <= 16) & ~special)
        if len(short):
            start[short], count[short] = self.look_up(canon, starts[short], n[short])
        rest = np.flatnonzero((n > 16) | special)
        pieces = [joined_canon[x:y] for x, y in zip(starts[rest].tolist(), ends[rest].tolist(), strict=True)] if len(rest) and (joined_canon := canon.tobytes()) else []
        fresh = list(dict.fromkeys(w for w in pieces if w not in self.long))
        self.long_bytes += sum(map(len, fresh))
        alone = [w for w in fresh if any(t in w for t in self.specials)]
        together = [w for w in fresh if w not in set(alone)] if alone else fresh
        self.long.update(zip(together, zip(*(x.tolist() for x in self.encode_new(together)), strict=True), strict=True))
        if alone:
            made = [self.ids_of(w) for w in alone]
            place = len(self.pool) + np.cumsum([0, *map(len, made)])
            self.long.update(zip(alone, zip(place.tolist(), map(len, made), strict=False), strict=True))
            self.pool = np.concatenate((self.pool, *made))
        if pieces:
            start[rest], count[rest] = np.array([self.long[w] for w in pieces]).T
        first, many = np.zeros(2 * len(starts), np.int64), np.zeros(2 * len(starts), np.int64)
        first[::2], many[::2] = start, count
        first[1::2], many[1::2] = np.where(last == 46, self.dot, self.comma), tail
        upto = np.cumsum(many)
        ids = self.pool[np.repeat(first - upto + many, many) + np.arange(int(many.sum()))]
        at = np.concatenate((np.searchsorted(starts, np.cumsum(sizes) - sizes), [len(starts)]))
        cuts = (4 * np.concatenate(([0], upto))[2 * at]).tolist()
        flat = ids.astype("<u4").tobytes()
        return [flat[x:y] for x, y in zip(cuts, cuts[1:], strict=False)]

    def look_up(self, canon: np.ndarray, starts: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(start, count) in the pool for pieces of up to 16 bytes."""
        words = np.ndarray((len(canon) - 7,), "<u8", canon, strides=(1,))
        a, b = words[starts] & MASKS[np.minimum(n, 8)], words[np.minimum(starts + 8, len(words) - 1)] & MASKS[np.maximum(n - 8, 0)]
        h = (a ^ (a >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + n.astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = (np.uint64(1) << np.uint64(max(1, len(h).bit_length()))) - np.uint64(1)
        order = (np.sort((h & ~low) | np.arange(len(h), dtype=np.uint64)) & low).astype(np.int64)
        differ = lambda x: x[order[1:]] != x[order[:-1]]
        new = differ(a) | differ(b) | differ(n)
        if np.count_nonzero(new) != np.count_nonzero(differ(h & ~low)):  # pieces that the upper bits do not tell apart
            order = np.lexsort((n, b, a))
            new = differ(a) | differ(b) | differ(n)
        new = np.concatenate(([True], new))
        group = np.empty(len(h), np.int64)
        group[order] = np.cumsum(new) - 1
        one = order[new]
        k = np.minimum(np.searchsorted(self.h, h[one]), max(0, len(self.h) - 1))
        known = (self.h[k] == h[one]) & (self.a[k] == a[one]) & (self.b[k] == b[one]) & (self.n[k] == n[one]) if len(self.h) else np.zeros(len(one), bool)
        start, count = np.zeros(len(one), np.int64), np.zeros(len(one), np.int64)
        start[known], count[known] = self.start[k[known]], self.count[k[known]]
        self.used[k[known]] = self.now
        fresh = np.flatnonzero(~known)
        if len(fresh):
            text = canon.tobytes()
            places = one[fresh]
            start[fresh], count[fresh] = self.encode_new([text[x:y] for x, y in zip(starts[places].tolist(), (starts[places] + n[places]).tolist(), strict=True)])
            by_hash = np.argsort(h[places], kind="stable")
            places, fresh = places[by_hash], fresh[by_hash]
            where = np.searchsorted(self.h, h[places])
            for name, values in (("h", h[places]), ("a", a[places]), ("b", b[places]), ("n", n[places]), ("start", start[fresh]), ("count", count[fresh]), ("used", np.full(len(fresh), self.now))):
                setattr(self, name, np.insert(getattr(self, name), where, values))
        return start[group], count[group]


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """One for each Python worker: later tasks find the pieces of earlier ones."""
    return WordCache(path)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, container_ids: int = 1 << 20) -> None:
    """Encode whole texts in ascending id order and write containers of about container_ids ids to path.

    A null text counts as empty (its only id is end_id); rows with a null id come first; rows of one id are ordered by
    their text, repeated rows are all kept. The table has columns part, before (ids of the part's
    earlier containers), doc_ids (binary, 8 bytes a row; nulls in
    null_ids, their number), n_ids and data.
    """
    spark = docs.sparkSession
    arrow_limits(spark, rows=2048, size="8m")
    schema = pa.schema([("part", pa.int32()), ("before", pa.int64()), ("null_ids", pa.int32()), ("doc_ids", pa.binary()), ("n_ids", pa.int64()), ("data", pa.binary())])
    end = b"" if end_id is None else np.array([end_id], "<u4").tobytes()

    def pack(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, cache = TaskContext.get().partitionId(), word_cache(tokenizer_path)
        keys: list[int | None] = []
        held: list[bytes] = []
        total = before = 0

        def flush() -> pa.RecordBatch:
            nulls = sum(k is None for k in keys)
            data = to_container(b"".join(held), np.cumsum([len(h) // 4 for h in held]))
            row = [[part], [before], [nulls], [np.array(keys[nulls:], "<i8").tobytes()], [total], [data]]
            return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for b in blocks:
            for key, ids in zip(b.column(0).to_pylist(), cache.encode(as_bytes(b.column(1))), strict=True):
                keys.append(key)
                held.append(ids + end)
                total += len(held[-1]) // 4
                if total >= container_ids:
                    yield flush()
                    keys, held, total, before = [], [], 0, before + total
        if keys:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t"))
    ordered = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), F.col("k").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("k").asc_nulls_first(), F.xxhash64("t"), "t")
    ordered.mapInArrow(tidy(pack), "part int, before long, null_ids int, doc_ids binary, n_ids long, data binary").write.option("compression", "uncompressed").parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """Every document of the containers at path: doc_id, start (ids before it), n_tokens, ids_crc32, ids (binary, LE u32)."""
    arrow_limits(spark, rows=4)
    table = spark.read.parquet(path)
    # one row a partition meets on the driver: its number is that of the write's tasks, whatever the data
    totals = sorted((r["part"], r["n"]) for r in table.groupBy("part").agg(F.max(F.col("before") + F.col("n_ids")).alias("n")).collect())
    base, run = {}, 0
    for part, n in totals:
        base[part], run = run, run + n
    table = table.select("part", "null_ids", "doc_ids", "data", "before")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])

    def unpack(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            for part, nulls, keys, data, before_it in zip(*(c.to_pylist() for c in b.columns), strict=True):
                box = Container(data)
                ends = np.fromiter((box.ends.get(i) for i in range(box.n_docs)), np.int64, box.n_docs)
                starts = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                flat = box.ids.astype("<u4").tobytes()
                ids = [flat[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                cols = [[None] * nulls + np.frombuffer(keys, "<i8").tolist(), starts + before_it + base[part], ends - starts, [zlib.crc32(x) for x in ids], ids]
                for i in range(0, len(ids), 4096):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + 4096], f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return table.mapInArrow(tidy(unpack), "doc_id long, start long, n_tokens long, ids_crc32 long, ids binary")


def op3_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = work_dir(spark, "token-files")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("word_bpe_49k.json"))
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
