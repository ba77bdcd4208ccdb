"""Bloom filters: one FNV-1 hash a key, further probes by double hashing. Filters are built from Arrow batches, probed by expressions."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# 32-bit FNV-1.
OFFSET, PRIME, MASK = 2166136261, 16777619, 0xFFFFFFFF


def n_probes(bits_per_key: int) -> int:
    return max(1, min(30, math.ceil(bits_per_key * 0.69)))


def n_bits(keys: int, bits_per_key: int) -> int:
    """At least 64, up to a whole number of bytes."""
    return -(-max(64, keys * bits_per_key) // 8) * 8


def fnv1(key: bytes) -> int:
    h = OFFSET
    for b in key:
        h = (h * PRIME & MASK) ^ b
    return h


def fnv1_column(key: Column) -> Column:
    """fnv1 of a binary column as a long."""
    digits = F.hex(key)
    n = F.length(key)
    codes = F.transform(F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("long"))
    return F.aggregate(codes, F.lit(OFFSET).cast("long"), lambda h, b: (h * PRIME).bitwiseAND(F.lit(MASK)).bitwiseXOR(b))


def probe(hash_: Column, bits: Column, i: Column) -> Column:
    """Bit number i of those that a key sets: h, h + delta, ... modulo the bits; delta is h turned right by 17."""
    step = F.shiftrightunsigned(hash_, 17).bitwiseOR(F.shiftleft(hash_, 15).bitwiseAND(F.lit(MASK)))
    return F.pmod((hash_ + i * step).bitwiseAND(F.lit(MASK)), bits)


def fnv1_of(keys: list[bytes]) -> np.ndarray:
    """fnv1 of many keys: one step for each place of a byte."""
    sizes = np.fromiter(map(len, keys), np.int64, len(keys))
    order = np.argsort(-sizes, kind="stable")
    raw = np.frombuffer(b"".join(keys), np.uint8)
    first = (np.cumsum(sizes) - sizes)[order]
    h = np.full(len(keys), OFFSET, np.uint64)
    longer = len(keys)
    for i in range(int(sizes.max(initial=0))):
        while longer and sizes[order[longer - 1]] <= i:
            longer -= 1
        h[:longer] = (h[:longer] * np.uint64(PRIME) & np.uint64(MASK)) ^ raw[first[:longer] + i]
    out = np.empty(len(keys), np.uint64)
    out[order] = h
    return out


def fnv1_batches(key: Column) -> Column:
    """fnv1_column by Arrow batches."""

    def run(keys: pa.Array) -> pa.Array:
        return pa.array(fnv1_of(keys.fill_null(b"").to_pylist()).astype(np.int64), pa.int64(), mask=keys.is_null().to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, T.LongType())(key.cast("binary"))


def build_words(keys: DataFrame, group: str, key: str, bits_per_key: int = 10) -> DataFrame:
    """(group, n_bits, word, bits): one filter a group, from its distinct keys; word i has the bits 64 i to 64 i + 63.

    A task sets the bits of its keys in words; equal words are OR-ed before and after the shuffle.
    """
    distinct = keys.select(group, key).distinct()
    sized = distinct.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select(group, (F.ceil(F.greatest(F.lit(64), F.col("n") * bits_per_key) / 8) * 8).cast("long").alias("n_bits"))
    k = n_probes(bits_per_key)
    schema = T.StructType([T.StructField(group, keys.schema[group].dataType), *(T.StructField(n, T.LongType()) for n in ("n_bits", "word", "bits"))])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            if not b.num_rows:
                continue
            groups = pa.array(b.column(0)).dictionary_encode()
            code = groups.indices.fill_null(len(groups.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            bits = b.column(1).to_numpy().astype(np.uint64)
            h = fnv1_of(b.column(2).to_pylist())
            step = (h >> np.uint64(17)) | ((h << np.uint64(15)) & np.uint64(MASK))
            at = np.concatenate([((h + np.uint64(i) * step) & np.uint64(MASK)) % bits for i in range(k)])
            code, bits = np.tile(code, k), np.tile(bits, k)
            word = (at >> np.uint64(6)).astype(np.int64)
            order = np.lexsort((word, code))
            heads = np.flatnonzero(np.concatenate(([True], (np.diff(code[order]) != 0) | (np.diff(word[order]) != 0))))
            made = np.bitwise_or.reduceat((np.uint64(1) << (at & np.uint64(63)))[order], heads)
            one = order[heads]
            kept = pa.array(b.column(0)).take(pa.array(one % b.num_rows))
            yield pa.RecordBatch.from_arrays([kept, pa.array(bits[one].astype(np.int64)), pa.array(word[one]), pa.array(made.view(np.int64))], names=schema.names)

    both = distinct.alias("k").join(sized.alias("s"), F.col(f"k.{group}").eqNullSafe(F.col(f"s.{group}")))
    words = both.select(f"k.{group}", "s.n_bits", F.coalesce(F.col(f"k.{key}").cast("binary"), F.lit(b"")).alias("key")).mapInArrow(run, schema)
    return words.groupBy(group, "n_bits", "word").agg(F.bit_or("bits").alias("bits"))


def set_bits(word: Column, bits: Column) -> Column:
    """The numbers of the bits set in a word, ascending."""
    return F.transform(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", bits, i) == 1), lambda i: word * 64 + i)


def build_bits(keys: DataFrame, group: str, key: str, bits_per_key: int = 10) -> DataFrame:
    """(group, n_bits, bits array of the set bit numbers): build_words with a row a filter."""
    words = build_words(keys, group, key, bits_per_key)
    return words.groupBy(group, "n_bits").agg(F.array_sort(F.flatten(F.collect_list(set_bits(F.col("word"), F.col("bits"))))).alias("bits"))


def words_of(filters: DataFrame, group: str) -> DataFrame:
    """build_bits as build_words."""
    at = filters.select(group, "n_bits", F.explode("bits").alias("_at")).select(group, "n_bits", F.shiftright("_at", 6).alias("word"), F.expr("shiftleft(1L, cast(_at % 64 as int))").alias("_bit"))
    return at.groupBy(group, "n_bits", "word").agg(F.bit_or("_bit").alias("bits"))


def may_hold(filters: DataFrame, asked: DataFrame, group: str, key: str, bits_per_key: int = 10) -> DataFrame:
    """asked(group, key) with `maybe`: false only if the group's filter has not all of the key's bits. filters: of build_words or build_bits.

    Each different hash asked of a filter goes as its bits to the words they are in, and its answers come together again; nothing
    holds a whole filter.
    """
    words = (filters if "word" in filters.columns else words_of(filters, group)).select(F.col(group).alias("_g"), "n_bits", F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    hashed = asked.withColumn("_h", fnv1_batches(F.col(key)))
    wanted = hashed.where(F.col(group).isNotNull() & F.col(key).isNotNull()).select(F.col(group).alias("_g"), "_h").distinct()
    sized = wanted.join(F.broadcast(words.groupBy("_g").agg(F.max("n_bits").alias("_n"))), "_g")  # a row a filter
    at = sized.select("_g", "_h", "_n", F.explode(F.array(*map(F.lit, range(n_probes(bits_per_key))))).alias("_i")).select("_g", "_h", probe(F.col("_h"), F.col("_n"), F.col("_i")).alias("_at"))
    tried = at.select("_g", "_h", F.shiftright("_at", 6).alias("_word"), (F.col("_at") % 64).cast("int").alias("_place")).join(words, ["_g", "_word"], "left")
    hit = F.coalesce(F.call_function("getbit", F.col("_bits"), F.col("_place")) == 1, F.lit(False))
    found = tried.groupBy("_g", "_h").agg(F.every(hit).alias("_hit")).withColumnRenamed("_h", "_f")
    joined = hashed.join(found, (F.col(group) == F.col("_g")) & (F.col("_h") == F.col("_f")), "left")
    return joined.select(*asked.columns, F.coalesce("_hit", F.lit(False)).alias("maybe"))


class Bloom:
    """The byte form: the bits, then one byte for the number of probes."""

    @staticmethod
    def build(keys: list[bytes], bits_per_key: int = 10) -> bytes:
        k, bits = n_probes(bits_per_key), n_bits(len(keys), bits_per_key)
        h = np.array([fnv1(x) for x in keys], dtype=np.uint64)
        step = (h >> np.uint64(17)) | ((h << np.uint64(15)) & np.uint64(MASK))
        cells = np.zeros(bits, dtype=np.uint8)
        for i in range(k):
            cells[(((h + np.uint64(i) * step) & np.uint64(MASK)) % np.uint64(bits)).astype(np.int64)] = 1
        return np.packbits(cells, bitorder="little").tobytes() + bytes([k])

    @staticmethod
    def may_hold(data: bytes, key: bytes) -> bool:
        if len(data) < 2:
            return False
        k, bits = data[-1], (len(data) - 1) * 8
        if k > 30:
            return True  # a form of a later version
        h = fnv1(key)
        step = (h >> 17) | (h << 15 & MASK)
        return all(data[p >> 3] >> (p & 7) & 1 for p in (((h + i * step) & MASK) % bits for i in range(k)))
