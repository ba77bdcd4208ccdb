"""Quality scores by nearest-neighbour voting in a latent-semantic space.

Terms are pairs of neighbouring byte classes of the whole text (letters, marks, digits, spaces, other characters) and a
few shares of repetition; a text's vector is its weighted terms, brought to few dimensions by the singular vectors of a
bounded sample of labelled texts. The sample's vectors are broadcast; a task multiplies blocks of its documents with all
of them, so each document's cosines are exact, and the nearest labels vote with weights that grow with similarity.
"""

from __future__ import annotations

import string
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import arrow_limits, as_bytes, tidy

#: Byte classes: each lower-case letter and mark, capitals, digits, space, line end, other white space and controls, UTF-8 lead and continuation bytes.
_singles = string.ascii_lowercase + string.punctuation + " \n"
CLASSES = np.array([_singles.index(chr(b)) if chr(b) in _singles else 60 if 65 <= b <= 90 else 61 if 48 <= b <= 57 else 62 if b < 128 else 63 if b < 192 else 64 for b in range(256)], dtype=np.uint8)
TABLE = CLASSES.tobytes()
N_CLASSES = 65
SHARES = 5
N_TERMS = N_CLASSES * N_CLASSES + SHARES
SAMPLE = 4000  # labelled rows that take part, at most
DIMENSIONS = 48
NEIGHBOURS = 15
BLOCK = 256


def terms(text: bytes | None) -> np.ndarray:
    """Root shares of the byte-class pairs, then shares of repeated words and lines, of capitals and of marks."""
    out = np.zeros(N_TERMS, dtype=np.float32)
    if not text:
        return out
    cls = np.frombuffer(text.translate(TABLE), np.uint8)
    if len(cls) > 1:
        pairs = np.zeros(N_TERMS - SHARES, dtype=np.int64)
        for k in range(0, len(cls) - 1, 1 << 20):
            part = cls[k : k + (1 << 20) + 1].astype(np.int32)
            pairs += np.bincount(part[:-1] * N_CLASSES + part[1:], minlength=len(pairs))
        out[:-SHARES] = np.sqrt(pairs / (len(cls) - 1))
    words, lines = text.split(), text.split(b"\n")
    n = max(1, len(words))
    out[-5] = sum(map(eq, words, words[1:])) / n
    out[-4] = 1 - len(set(lines)) / len(lines)
    out[-3] = 1 - np.log(len(set(words))) / np.log(n) if n > 1 else 0
    count = np.bincount(cls, minlength=N_CLASSES)
    out[-2] = count[60] / len(cls)
    out[-1] = count[26:58].sum() / len(cls)
    return out


@dataclass
class Model:
    weights: np.ndarray  # of terms
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # labelled, of unit length
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    def place(self, rows: np.ndarray) -> np.ndarray:
        v = (rows * self.weights) @ self.axes
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return np.divide(v, norm, out=np.zeros_like(v), where=norm > 0)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Shares of the similarity-weighted votes for label 1; the labels' mean where there is no vote."""
        prior = float(self.labels.mean()) if len(self.labels) else 0.5
        if not len(self.labels) or not len(rows):
            return np.full(len(rows), prior)
        cos = self.place(rows) @ self.vectors.T
        k = min(self.neighbours, cos.shape[1])
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        sim = np.clip(np.take_along_axis(cos, near, axis=1).astype(np.float64), 0, 1) ** 16
        total = sim.sum(axis=1)
        return np.where(total > 0, (sim * self.labels[near]).sum(axis=1) / np.maximum(total, 1e-300), prior)


def singular_axes(a: np.ndarray, k: int, rounds: int = 4) -> np.ndarray:
    """The first k right singular vectors of a, by subspace iteration from a fixed start."""
    k = min(k, *a.shape)
    q = np.linalg.qr(a.T @ np.random.default_rng(0).standard_normal((a.shape[0], k + 8)).astype(np.float32))[0]
    for _ in range(rounds):
        q = np.linalg.qr(a.T @ (a @ q))[0]
    _, _, vt = np.linalg.svd(a @ q, full_matrices=False)
    return (q @ vt.T[:, :k]).astype(np.float32)


def term_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, terms as binary of nonzero places and values)."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            rows = []
            for t in as_bytes(b.column(1)):
                v = terms(t)
                at = np.flatnonzero(v).astype("<u2")
                rows.append(at.tobytes() + v[at].astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, pa.binary())], names=["doc_id", "terms"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, terms binary")


def in_fold(column) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, dimensions: int = DIMENSIONS, neighbours: int = NEIGHBOURS) -> Model:
    """Learn from at most `sample` labelled documents outside the held-out fold, picked by a hash of their id.

    Several labels of one id are averaged (at least one half: 1), null labels and ids are left out, and of several texts
    of one id the least counts. Only the sample's ids and term vectors reach the driver.
    """
    spark = docs.sparkSession
    arrow_limits(spark)
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~in_fold(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    # labels may be of documents that are not here
    here = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    known = known.join(here, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    picked = {r["doc_id"]: r["y"] for r in known.collect()}
    ids = spark.createDataFrame([(k,) for k in picked], "doc_id long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    found = {r["doc_id"]: bytes(r["terms"]) for r in term_rows(texts).collect()}
    order = [k for k in picked if k in found]
    a = np.zeros((len(order), N_TERMS), dtype=np.float32)
    for i, k in enumerate(order):
        n = len(found[k]) // 6
        a[i, np.frombuffer(found[k], "<u2", n)] = np.frombuffer(found[k], "<f4", n, 2 * n)
    weights = np.log((1 + len(order)) / (1 + (a > 0).sum(axis=0))).astype(np.float32) + 1
    weights[-SHARES:] = 2
    model = Model(weights, np.zeros((N_TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.array([picked[k] for k in order], dtype=np.float64), neighbours)
    if order:
        model.axes = singular_axes(a * weights, dimensions)
        model.vectors = model.place(a)
    return model


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a double column of scores appended (replaced, if docs has it). Rows are independent; no shuffle."""
    spark = docs.sparkSession
    arrow_limits(spark)
    shared = spark.sparkContext.broadcast(model)  # its size is bounded by SAMPLE and DIMENSIONS
    kept = [f for f in docs.schema.fields if f.name != name]
    schema, at = T.StructType([*kept, T.StructField(name, T.DoubleType())]), [f.name for f in kept].index("text")

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            texts, out = as_bytes(b.column(at)), []
            for k in range(0, len(texts), BLOCK):
                out.append(shared.value.scores(np.stack([terms(t) for t in texts[k : k + BLOCK]])))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())], names=schema.names)

    return docs.select(*[F.col(f"`{f.name}`") for f in kept]).mapInArrow(tidy(run), schema)


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    out = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return out.select("doc_id", in_fold(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
