"""SimHash near-duplicates by multi-index hashing.

A fingerprint of 64 bits has two segments of 32 bits. Fingerprints at a distance of 3 or less differ by at most one bit
in one of the segments, so one looks up, for each segment, its Hamming ball of radius one in the table of that segment,
and the complete distance is then verified. Of two segments that differ in one bit one has that bit set: only set bits
are flipped when a ball is enumerated, which halves it. Equal fingerprints are one entry from the start.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, as_bytes, joined_by, tidy, written
from tidemark.llm.components import components, in_one_task

CHUNK = 1 << 15


def fingerprint(text: bytes | None, width: int = 3) -> int:
    """Unsigned 64-bit SimHash of the width-word shingles of text."""
    import xxhash

    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = list(accumulate(len(w) + 1 for w in words))
    width = min(width, len(words))
    spans = list(zip([0, *ends], ends[width - 1 :]))
    ones = np.zeros(64, dtype=np.int64)
    for k in range(0, len(spans), CHUNK):
        raw = b"".join([digest(joined[s : e - 1], 42) for s, e in spans[k : k + CHUNK]])
        ones += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(spans)).tobytes(), "big")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, rk, fp): rk is a hash of the text, fp the fingerprint as a signed long; null and wordless texts give 0."""
    arrow_limits(docs.sparkSession)

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            fps = np.array([fingerprint(t, width) for t in as_bytes(b.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(fps.view(np.int64))], names=["doc_id", "rk", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("rk")).mapInArrow(tidy(run), "doc_id long, rk long, fp long")


def _segment(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 32) if k == 0 else fp.bitwiseAND(F.lit(0xFFFFFFFF))


def links(fps: DataFrame, bits: int = 3) -> DataFrame:
    """Distinct fingerprints fps(fp) -> verified pairs (a, b) at a distance of 1 to bits (3 at most)."""
    if bits > 3:
        raise ValueError("two segments with balls of radius one find distances up to 3")
    fp = F.col("fp")
    table = fps.select("fp", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _segment(fp, k).alias("key")) for k in (0, 1)])).alias("s")).select("fp", "s.k", "s.key")
    # the key itself (once for a pair of equal segments: see the order below) and the key with each set bit cleared
    masks = F.array(*[F.lit(1 << b) for b in range(32)])
    ball = F.concat(F.array(F.lit(0).cast("long")), F.filter(masks, lambda m: F.col("key").bitwiseAND(m) != 0))
    probes = table.select(F.col("fp").alias("a"), "k", F.explode(F.transform(ball, lambda m: F.struct(F.col("key").bitwiseXOR(m).alias("key"), (m == 0).alias("same")))).alias("p")).select("a", "k", "p.key", "p.same")
    far = F.bit_count(F.col("a").bitwiseXOR(F.col("fp")))
    return probes.join(table, ["k", "key"]).where((F.col("a") != F.col("fp")) & (far <= bits) & (~F.col("same") | (F.col("a") < F.col("fp")))).select("a", F.col("fp").alias("b"))


def grouped(docs: DataFrame, id_col: str, text_col: str, width: int, bits: int) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows(doc_id, rk, fp) of the documents; classes(fp, best, refs) with the first of a group's (no_id, doc_id, rk)."""
    rows = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    least = written(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")).alias("least"), F.count(F.lit(1)).alias("refs")), "distinct")
    pairs = written(links(least.select("fp"), bits), "links")
    found = components(pairs, "components").withColumnRenamed("node", "fp")
    named = written(least.join(found, "fp", "left").select("fp", "least", "refs", F.coalesce("root", "fp").alias("root")), "named")
    best = named.groupBy("root").agg(F.min("least").alias("best"))
    return rows, written(named.join(best, "root").select("fp", "best", "refs"), "classes")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id that links of at most `bits` differing bits reach, the document's own included.
    Null, empty and wordless texts have fingerprint zero and link like any other. Rows of one doc_id and repeated rows
    each give a row. A null doc_id takes part in linking but names no component (null where no id is in reach).
    """
    rows, classes = grouped(docs, id_col, text_col, width, bits)
    return joined_by(rows, classes, ["fp"], "refs", rows.count()).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("best.doc_id").alias("component_id"))


def only(docs: DataFrame, keepers: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of docs whose (id, hash of the text) keepers(doc_id, rk) has; of rows that repeat it one stays. docs may have any columns."""
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = dict(zip(docs.columns, inner, strict=True))
    plain = docs.toDF(*inner).withColumn("rk", F.xxhash64(at[text_col])).withColumn("doc_id", F.col(at[id_col]).cast("long"))
    same = (F.col("d.rk") == F.col("k.rk")) & F.col("d.doc_id").eqNullSafe(F.col("k.doc_id"))
    keepers = keepers.groupBy("doc_id", "rk").agg(F.count(F.lit(1)).alias("n"))
    kept = plain.alias("d").join(keepers.alias("k"), same).select("d.*", "k.n")
    # rows that repeat a kept one in id and text: one of them stays
    again = kept.where("n > 1").dropDuplicates(["doc_id", "rk"]) if keepers.where("n > 1").limit(1).count() else kept.where("false")
    return kept.where("n = 1").unionByName(again).select(*[F.col(i).alias(c) for c, i in at.items()])


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 3) -> DataFrame:
    """docs with one document of each group: the one of least id (no id comes last; of equal ids the least text hash)."""
    rows, classes = grouped(docs, id_col, text_col, width, bits)
    every = joined_by(rows, classes, ["fp"], "refs", rows.count())
    keepers = written(every.where((F.col("rk") == F.col("best.rk")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))).select("doc_id", "rk"), "keepers")
    return only(docs, keepers, id_col, text_col)


# ---- near duplicates by the similarity of their texts

ERRORS = 0.1  # a pair with this share of differing bits and ALIKE of all its shingles in common (some 5 words in 100 edited)
ALIKE = 0.63  # is looked up with a chance of MISSED to fail
MISSED = 0.01
FAR_BITS = 0.3  # pairs with a greater share of differing bits are not looked at further
SHINGLE_BITS = 13  # of a segment's bits, those that a least shingle in common stands for
POOL = 256  # bits of a SimHash that the segments are picked from
ALONE = 1 << 18  # links that one task puts together; more are joined


def segments_for(n: int) -> tuple[int, int]:
    """(bits of a segment, number of segments) for n texts: chance brings a text together with few others in a segment, whatever n,
    and a pair with ERRORS and ALIKE agrees in some segment with a chance of 1 - MISSED."""
    bits = max(24, n.bit_length() + 11)
    one = ALIKE * (1 - ERRORS) ** (bits - SHINGLE_BITS)
    return bits, math.ceil(math.log(MISSED) / math.log(1 - one))


class WordBits:
    """SimHash of a text's different words, of any number of bits; the bits of words met before are kept, up to a bound in bytes."""

    def __init__(self, bits: int):
        self.bits, self.rows = bits, max(1024, (32 << 20) // bits)
        self.number: dict[bytes, int] = {}
        self.table = np.zeros((self.rows, bits), np.uint8)

    def of(self, text: bytes) -> np.ndarray:
        """0 or 1 for each bit: 1 if set in over half of the words."""
        words = list(set(text.lower().split()))
        ones = np.zeros(self.bits, np.int64)
        step = min(1024, self.rows)
        for k in range(0, len(words), step):
            part = words[k : k + step]
            new = [w for w in part if w not in self.number]
            if len(self.number) + len(new) > self.rows:
                self.number.clear()
                new = part
            if new:
                n, first = -(-self.bits // 8), len(self.number)
                raw = np.frombuffer(b"".join([hashlib.shake_128(w).digest(n) for w in new]), np.uint8).reshape(len(new), n)
                self.table[first : first + len(new)] = np.unpackbits(raw, axis=1)[:, : self.bits]
                self.number.update(zip(new, range(first, first + len(new)), strict=True))
            ones += self.table[[self.number[w] for w in part]].sum(axis=0, dtype=np.int64)
        return (2 * ones > len(words)).astype(np.uint8)


class Segments:
    """The keys of a text's segments: the least of its shingles by a hash that two segments share, with bits of its SimHash that the segment picks."""

    def __init__(self, n: int, width: int):
        bits, self.count = segments_for(n)
        draw = np.random.Generator(np.random.PCG64(42))
        self.pick = np.stack([draw.permutation(POOL)[: bits - SHINGLE_BITS] for _ in range(self.count)])
        self.weights = np.int64(1) << np.arange(bits - SHINGLE_BITS, dtype=np.int64)
        hashes = -(-self.count // 2)
        self.by = np.arange(self.count) % hashes
        self.places, self.flip, self.turn, self.own = (draw.integers(1 << 63, size=k, dtype=np.uint64) * np.uint64(2) + np.uint64(1) for k in (width, hashes, hashes, self.count))
        self.width = width

    @staticmethod
    def mix(h: np.ndarray) -> np.ndarray:
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(29))

    def of(self, text: bytes, bits: np.ndarray) -> np.ndarray:
        """A long for each segment, for a text and its SimHash."""
        import xxhash

        words = text.lower().split()
        least = np.full(len(self.flip), 0xFFFFFFFFFFFFFFFF, np.uint64)
        width = min(self.width, len(words))
        for k in range(0, len(words) - width + 1 if words else 0, CHUNK):
            some = words[k : k + CHUNK + width - 1]
            h = np.fromiter(map(xxhash.xxh64_intdigest, some), np.uint64, len(some))
            n = len(some) - width + 1
            h = self.mix(sum(h[j : j + n] * self.places[j] for j in range(width)))
            for i in range(len(least)):
                least[i] = min(least[i], ((h ^ self.flip[i]) * self.turn[i]).min())
        picked = (bits[self.pick] @ self.weights).astype(np.uint64)
        return self.mix(self.mix(least[self.by] + self.own) ^ (picked * self.own)).view(np.int64)


def shingles(text: bytes, width: int) -> list[bytes]:
    words = text.lower().split()
    return [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []


def similarity(a: list[bytes], b: list[bytes], b_set: set[bytes], width: int) -> float:
    """The share of the words of each text that stand in a shingle of the other: the smaller share of the two."""
    out, a_set = 1.0, set(a)
    for mine, other in ((a, b_set), (b, a_set)):
        n = len(mine) + width - 1 if len(mine) > 1 else 1
        covered = end = 0
        for i, x in enumerate(mine):
            if x in other:
                stop = i + (width if len(mine) > 1 else 1)
                covered += stop - max(end, i)
                end = stop
        out = min(out, covered / n) if mine and other else float(not mine and not other)
    return out


def keep_dissimilar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document of each group of near duplicates: the one of least id (no id comes last; of equal ids the least text hash).

    Two texts are near duplicates if at least `least` of the words of each stand in shingles of `width` words that both have.
    Upper and lower case of A-Z and kinds of white space make no difference; null, empty and wordless texts are one group.

    Candidates come from multi-index hashing: a key of a segment is the least of the text's shingles by a hash of the segment,
    together with some bits of a SimHash of its different words. Texts without a common shingle do not meet, whatever words they
    share, and texts that share a frequent line meet only if the rest of their words is alike too, so the entries a text has
    hardly grow with the table. Texts of one key are a bucket. All of a bucket try its first; those that are not in its
    group then answer too, eight times as many each time, and all of the bucket outside their group try them, until each two
    of a bucket are in one group or were tried. Links within what is one group already are not looked at, so a group of any
    size gives a few links a text and no pairs. Distances of the SimHash are looked at first, then the similarity of the texts
    itself. A pair is missed with a chance that ERRORS, ALIKE and MISSED bound (see segments_for); none is linked that is not alike.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("rk"), F.xxhash64(F.lit("second"), text_col).alias("rk2"))
    n = docs.count()

    def sketches(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, segments = WordBits(POOL), Segments(n, width)
        for b in blocks:
            made, slots = [], []
            for t in as_bytes(b.column(3)):
                bits = known.of(t or b"")
                made.append(np.packbits(bits).tobytes())
                slots.append(segments.of(t or b"", bits))
            ends = pa.array(np.arange(len(slots) + 1, dtype=np.int32) * segments.count)
            keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(slots) if slots else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.binary()), keys], names=["doc_id", "rk", "rk2", "fp", "slots"])

    rows = plain.select("doc_id", "rk", "rk2", "text").mapInArrow(tidy(sketches), "doc_id long, rk long, rk2 long, fp binary, slots array<long>")
    # equal texts are one node from here on
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "rk")
    nodes = rows.groupBy("rk", "rk2").agg(F.min(first).alias("least"), F.first("fp").alias("fp"), F.first("slots").alias("slots"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "rk", "rk2", "least", "fp", "slots"), "near-nodes")
    entries = nodes.select("node", F.explode("slots").alias("slot"))
    buckets = entries.groupBy("slot").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("size")).where("size > 1").select("slot", "head")
    met = written(entries.join(buckets, "slot"), "near-met")  # slot, node, head
    texts = texts_of(plain, nodes, met.select("node").distinct())
    fps = nodes.select("node", "fp")

    linked = roots = None

    def link(asked: DataFrame) -> None:
        """Links those of asked(node, rep) that are near duplicates."""
        nonlocal linked, roots
        alike = written(verified(texts, asked, width, least), "near-alike")
        if not alike.isEmpty():
            linked = alike if linked is None else linked.unionByName(alike)
            edges = linked.select(F.col("node").alias("a"), F.col("rep").alias("b"))
            roots = written(in_one_task(edges) if edges.count() <= ALONE else components(edges, "near-components"), "near-roots")

    tried = met.where("node <> head").select("slot", "node", F.col("head").alias("rep"))
    left, answered = tried, met.select("slot", F.col("head").alias("node")).distinct()
    for level in itertools.count(1):
        close = written(near(tried.select(F.greatest("node", "rep").alias("node"), F.least("node", "rep").alias("rep")).distinct(), fps), "near-close")
        if not close.isEmpty():
            # first a text's least candidate, which brings a large group together; then a candidate for any two groups; then what is still apart
            if level == 1:
                link(close.groupBy("node").agg(F.min("rep").alias("rep")))
            for one in (True, False):
                asked = written(apart(close, roots, one), "near-asked")
                if asked.isEmpty():
                    break
                link(asked)
        # who is not in the group of its bucket's head answers too, if it has not yet; where none was tried, a bucket is done
        left = left.select("slot", "node") if level == 1 else left.join(tried.select("slot").distinct(), "slot", "left_semi").select("slot", "node")
        left = left.join(answered, ["slot", "node"], "left_anti").join(met, ["slot", "node"]).withColumnRenamed("head", "rep")
        left = written(apart(left, roots).select("slot", "node"), "near-left")
        if left.isEmpty():
            break
        nth = F.row_number().over(Window.partitionBy("slot").orderBy("node"))
        now = written(left.withColumn("nth", nth).where(F.col("nth") <= 8**level).select("slot", F.col("node").alias("rep")), "near-now")
        others = met.join(answered, ["slot", "node"], "left_anti").select("slot", "node").join(left.withColumn("asks", F.lit(True)), ["slot", "node"], "left")
        group = nodes.select("node").withColumn("root", F.col("node")) if roots is None else roots
        others = others.join(group, "node", "left").withColumn("root", F.coalesce("root", "node"))
        reps = now.join(group.select(F.col("node").alias("rep"), F.col("root").alias("rep_root")), "rep", "left").withColumn("rep_root", F.coalesce("rep_root", "rep"))
        # two that both answer meet once
        tried = others.join(reps, "slot").where((F.col("root") != F.col("rep_root")) & (F.col("asks").isNull() | (F.col("node") > F.col("rep"))))
        tried = written(tried.select("slot", "node", "rep"), "near-tried")
        if tried.isEmpty():
            break
        answered = answered.unionByName(now.withColumnRenamed("rep", "node"))
    named = nodes.select("node", "least")
    named = named.select("least", F.col("node").alias("root")) if roots is None else named.join(roots, "node", "left").select("least", F.coalesce("root", "node").alias("root"))
    best = named.groupBy("root").agg(F.min("least").alias("least")).select("least.doc_id", "least.rk")
    same = (F.col("p.rk") == F.col("b.rk")) & F.col("p.doc_id").eqNullSafe(F.col("b.doc_id"))
    keepers = written(plain.select("doc_id", "rk").alias("p").join(best.alias("b"), same).select("p.doc_id", "p.rk"), "near-keepers")
    return only(docs, keepers, id_col, text_col)


def apart(pairs: DataFrame, roots: DataFrame | None, one: bool = False) -> DataFrame:
    """The rows of pairs(node, rep, ...) whose texts are not in one group yet; with one, a row for any two groups.
    roots(node, root) has the texts with a link (None: there are no links)."""
    if roots is None:
        return pairs
    of_node, of_rep = roots.withColumnRenamed("root", "_a"), roots.select(F.col("node").alias("rep"), F.col("root").alias("_b"))
    both = pairs.join(of_node, "node", "left").join(of_rep, "rep", "left").withColumn("_a", F.coalesce("_a", "node")).withColumn("_b", F.coalesce("_b", "rep")).where("_a <> _b")
    if one:
        both = both.groupBy(F.least("_a", "_b"), F.greatest("_a", "_b")).agg(F.min(F.struct(*pairs.columns)).alias("_row")).select("_row.*")
    return both.select(*pairs.columns)


def near(pairs: DataFrame, fps: DataFrame) -> DataFrame:
    """pairs(node, rep) whose SimHashes, of fps(node, fp), are not far from each other."""
    both = pairs.join(fps, "node").join(fps.select(F.col("node").alias("rep"), F.col("fp").alias("rep_fp")), "rep").select("node", "rep", "fp", "rep_fp")

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            if b.num_rows:
                a, c = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (2, 3))
                keep = pa.array(np.bitwise_count(a ^ c).sum(axis=1) <= FAR_BITS * POOL)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["node", "rep"]).filter(keep)

    return both.mapInArrow(tidy(run), "node long, rep long")


def texts_of(plain: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, text) of the wanted nodes, written."""
    wanted = written(wanted.join(nodes.select("node", "rk", "rk2", "least"), "node"), "near-wanted")  # where that is small, it goes to the texts
    one = (F.col("p.rk") == F.col("w.rk")) & (F.col("p.rk2") == F.col("w.rk2")) & F.col("p.doc_id").eqNullSafe(F.col("w.least.doc_id"))
    return written(plain.alias("p").join(wanted.alias("w"), one).select("w.node", "p.text").dropDuplicates(["node"]), "near-texts")


def verified(texts: DataFrame, pairs: DataFrame, width: int, least: float) -> DataFrame:
    """pairs(node, rep) that are near duplicates by their texts."""
    read = pairs.join(texts, "node").join(texts.select(F.col("node").alias("rep"), F.col("text").alias("rep_text")), "rep").select("node", "rep", "text", "rep_text")

    def alike(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, other, other_set = None, [], set()
        for b in blocks:
            keep = []
            for rep, a, c in zip(b.column(1).to_pylist(), as_bytes(b.column(2)), as_bytes(b.column(3)), strict=True):
                if rep != last:
                    last, other = rep, shingles(c or b"", width)
                    other_set = set(other)
                keep.append(similarity(shingles(a or b"", width), other, other_set, width) >= least)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["node", "rep"]).filter(pa.array(keep, pa.bool_()))

    return read.mapInArrow(tidy(alike), "node long, rep long")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
