"""Exact top-k search with a vector-approximation file.

The file has a row for every different integer vector: the cell of each component (8 bits: 256 cells between bounds taken from
the corpus), the exact components, and the ids that have the vector, the k + 1 least of them, as no result needs more.

Phase 1 reads the cells alone. One product with the cells' middles bounds the inner product with a query from both sides:
the slack is the query's sum of absolute components times half the widest cell. Queries go in blocks of a fixed size, each
broadcast once; a task keeps the k-th lower bound of each query over all that it has seen, so it hands on little more than
k candidates a query. The k-th lower bound over all tasks then decides which candidates are left.

Phase 2 reads the exact vectors of those candidates only and scores each query's in the order of their bounds until the k-th
result is certain.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import arrow_limits, batches, tidy, work_dir, written

CELLS = 256
QUERY_BLOCK = 4096  # queries broadcast at once
STRIP = 256  # queries whose bounds are held in memory at once
ROWS = 4096
FAR = 2.0**62  # components saturate here
ENDS = (-(1 << 63), (1 << 63) - 1)  # scores saturate here
FILE = "rid long, cells binary, v array<long>, ids array<struct<id:long,m:int>>"


def quantised(table: DataFrame, id_col: str, vector_col: str, scale: int, saturate: bool) -> DataFrame:
    """(id, v array<long>): components floor(scale * x) of the usable rows."""
    x = F.col(vector_col)
    real = F.filter(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    usable = F.col(id_col).isNotNull() & x.isNotNull() & (F.size(real) == F.size(x))

    def whole(c):
        scaled = c.cast("double") * scale
        near = F.floor(F.greatest(F.least(scaled, F.lit(FAR)), F.lit(-FAR))).cast("long")
        return near if saturate else F.when(F.abs(scaled) > FAR, F.raise_error(F.lit("a component is beyond 2**62")).cast("long")).otherwise(near)

    return table.where(usable).select(F.col(id_col).cast("long").alias("id"), F.transform(x, whole).alias("v"))


def matrix(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, rows) for each length of vector in the column."""
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    flat, first = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    out = []
    for n in np.unique(sizes):
        rows = np.flatnonzero(sizes == n)
        out.append((rows, flat[first[rows][:, None] + np.arange(n)].astype(np.int64)))
    return out


def write_file(vectors: DataFrame, path: str, k: int, every_row: bool) -> None:
    """The approximation file at path: rid, cells, v, ids. The range of the components is in path-bounds.

    A vector that very many rows share is one row from here on: equal rows are counted up to k, and of the ids of a vector
    every task keeps the least k + 1 before they meet.
    """
    spark = vectors.sparkSession
    # one row for each length of vector: the range of its components
    bounds = vectors.select(F.size("v").alias("n"), F.array_min("v").alias("lo"), F.array_max("v").alias("hi")).groupBy("n").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    bounds.write.parquet(path + "-bounds")
    arrow_limits(spark, rows=ROWS)
    edges = read_bounds(spark, path)
    count = F.least(F.count(F.lit(1)), F.lit(k)).cast("int") if every_row else F.first(F.lit(1))
    each = vectors.groupBy("v", "id").agg(count.alias("m"))
    nth = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = each.withColumn("nth", nth).where(F.col("nth") <= k + 1).groupBy("v").agg(F.array_sort(F.collect_list(F.struct("id", "m"))).alias("ids"))

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks:
            cells: list[bytes] = [b""] * b.num_rows
            for rows, v in matrix(b.column(1)):
                if n := v.shape[1]:
                    code = np.minimum(np.searchsorted(edges[n], v, "right") - 1, CELLS - 1).astype(np.uint8)
                    for r, c in zip(rows.tolist(), code, strict=True):
                        cells[r] = c.tobytes()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(cells, pa.binary()), b.column(1), b.column(2)], names=["rid", "cells", "v", "ids"])

    few.select(F.monotonically_increasing_id().alias("rid"), "v", "ids").mapInArrow(tidy(run), FILE).write.parquet(path)


def read_bounds(spark: SparkSession, path: str) -> dict[int, np.ndarray]:
    """{length of vector: lower ends of the cells}; integer ends, so that cell k holds ends[k] to ends[k + 1] - 1."""
    out = {}
    for r in spark.read.schema("n int, lo long, hi long").parquet(path + "-bounds").collect():
        lo, hi = (r["lo"] or 0), (r["hi"] or 0)
        out[r["n"]] = np.array([lo + (hi + 1 - lo) * k // CELLS for k in range(CELLS + 1)], dtype=np.int64)
    return out


def exact_type(n: int, a: int, b: int):
    """A type in which inner products of n components up to a and b are exact."""
    if n * a * b < 1 << 24:
        return np.float32
    if n * a * b < 1 << 53:
        return np.float64
    return np.int64 if n * a * b < 1 << 63 else object


class Bounds:
    """A block of queries of one length: what the cells say about their scores, and the k-th lower bounds so far."""

    def __init__(self, numbers: np.ndarray, q_ids: np.ndarray, q: np.ndarray, edges: np.ndarray, k: int):
        self.numbers, self.q_ids, self.k = numbers, q_ids, k
        ends = [int(e) for e in edges]
        # twice the middles and the widest cell, so all is in whole numbers
        middles, widths = [a + b - 1 for a, b in zip(ends, ends[1:], strict=False)], [max(0, b - 1 - a) for a, b in zip(ends, ends[1:], strict=False)]
        self.kind = exact_type(max(1, q.shape[1]), int(np.abs(q).max(initial=1)), 2 * max([1, *map(abs, middles), *widths]))
        self.q, self.middles = q.astype(self.kind), np.array(middles, dtype=self.kind)
        self.slack = np.abs(self.q).sum(axis=1) * max(widths) if q.shape[1] else np.zeros(len(q), self.kind)
        self.least = [np.zeros((0,), self.kind)] * len(q)  # of each query: the k greatest lower bounds, of different keys
        self.keys = [np.zeros(0, np.int64)] * len(q)

    def meet(self, cells: np.ndarray, first: np.ndarray, many: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """(query, rows, lower, upper bounds) of the rows that may be among the best k; bounds are of twice the score.

        first: the least id of each row; many: it has others; keys: what counts once.
        """
        middles = self.middles[cells]
        for s in range(0, len(self.q), STRIP):
            twice = self.q[s : s + STRIP] @ middles.T
            for i, dot in enumerate(twice, s):
                low, high = dot - self.slack[i], dot + self.slack[i]
                if self.kind is object:
                    low, high = np.clip(low, 2 * ENDS[0], 2 * ENDS[1]), np.clip(high, 2 * ENDS[0], 2 * ENDS[1])
                own = first == self.q_ids[i]
                counted = np.flatnonzero(~own) if own.any() else np.arange(len(dot))
                have = self.least[i]
                if len(have) == self.k:
                    counted = counted[low[counted] > have[-1]]
                if len(counted) > self.k:  # the k greatest of different keys are among the greatest of each key
                    order = counted[np.argsort(-low[counted], kind="stable")]
                    counted = order[np.sort(np.unique(keys[order], return_index=True)[1])][: self.k]
                if len(counted):
                    low_all, key_all = np.concatenate((have, low[counted])), np.concatenate((self.keys[i], keys[counted]))
                    order = np.argsort(-low_all, kind="stable")
                    order = order[np.sort(np.unique(key_all[order], return_index=True)[1])][: self.k]
                    self.least[i], self.keys[i] = low_all[order], key_all[order]
                have = self.least[i]
                may = high >= have[-1] if len(have) == self.k else np.ones(len(dot), bool)
                rows = np.flatnonzero(may.astype(bool) & (~own | many))
                if len(rows):
                    yield i, rows, low[rows], high[rows]

    def certain(self, i: int) -> int | None:
        """Twice the score that k results of query i reach at least."""
        return int(self.least[i][-1]) if len(self.least[i]) == self.k else None


CANDIDATE = pa.schema([("qn", pa.int64()), ("rid", pa.int64()), ("key", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
CANDIDATES = "qn long, rid long, key long, lo long, hi long"


def candidates(spark: SparkSession, path: str, asked: DataFrame, k: int, every_row: bool) -> DataFrame:
    """Phase 1: (qn, rid, hi) of the vectors that may be among the k best of the queries asked(qn, id, v), over all tasks."""
    edges = read_bounds(spark, path)
    file = spark.read.schema(FILE).parquet(path).select("rid", "cells", F.element_at("ids", 1)["id"].alias("first"), (F.size("ids") > 1).alias("many"))
    out = work_dir(spark, "va-candidates")
    block: list = []

    def flush() -> None:
        by_size: dict[int, list] = {}
        for r in block:
            by_size.setdefault(len(r["v"]), []).append(r)
        packed = {n: (np.array([r["qn"] for r in rows], np.int64), np.array([r["id"] for r in rows], np.int64), np.array([r["v"] for r in rows], np.int64).reshape(len(rows), n)) for n, rows in by_size.items()}
        shared = spark.sparkContext.broadcast(packed)
        block.clear()

        def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                bounds = {n: Bounds(*q, edges[n], k) for n, q in shared.value.items() if n in edges}
                held: dict[tuple[int, int], list[tuple]] = {}
                kept = 0
                for b in blocks:
                    rid, first, many = b.column(0).to_numpy(), b.column(2).to_numpy(), b.column(3).to_numpy(zero_copy_only=False)
                    raw = b.column(1).to_pylist()
                    sizes = np.array([len(c) for c in raw])
                    for n in np.unique(sizes).tolist():
                        if n not in bounds:
                            continue
                        at = np.flatnonzero(sizes == n)
                        cells = np.frombuffer(b"".join(raw[i] for i in at.tolist()), np.uint8).reshape(len(at), n)
                        keys = rid[at] if every_row else first[at]
                        for i, found, low, high in bounds[n].meet(cells, first[at], many[at], keys):
                            held.setdefault((n, i), []).append((rid[at][found], keys[found], low, high))
                            kept += len(found)
                    if kept > 1 << 20:
                        yield from told(bounds, held)
                        held, kept = {}, 0
                yield from told(bounds, held)

            yield from batches(rows(), CANDIDATE)

        def told(bounds: dict[int, Bounds], held: dict[tuple[int, int], list[tuple]]) -> Iterator[tuple]:
            for (n, i), parts in held.items():
                rid, key, low, high = (np.concatenate(c) for c in zip(*parts, strict=True))
                bound, number = bounds[n].certain(i), int(bounds[n].numbers[i])
                for r, x, lo, hi in zip(rid.tolist(), key.tolist(), low.tolist(), high.tolist(), strict=True):
                    if bound is None or hi >= bound:
                        yield number, r, x, -(-int(lo) // 2), int(hi) // 2

        file.mapInArrow(tidy(run), CANDIDATES).write.mode("append").parquet(out)
        shared.unpersist()

    arrow_limits(spark, rows=ROWS)
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == QUERY_BLOCK:
            flush()
    flush()
    found = spark.read.schema(CANDIDATES).parquet(out)
    lows = found.select("qn", "key", "lo") if every_row else found.groupBy("qn", "key").agg(F.max("lo").alias("lo"))
    nth = F.row_number().over(Window.partitionBy("qn").orderBy(F.desc("lo")))
    bound = lows.withColumn("nth", nth).where(F.col("nth") <= k).groupBy("qn").agg(F.count(F.lit(1)).alias("n"), F.min("lo").alias("lo")).where(F.col("n") == k).select("qn", F.col("lo").alias("bound"))
    return written(found.join(bound, "qn", "left").where("bound is null or hi >= bound").select("qn", "rid", "hi"), "va-left")


def certain_results(rows: DataFrame, k: int, every_row: bool, saturate: bool) -> DataFrame:
    """Phase 2: (qn, query_id, times, hi, qv, v, ids) by qn and falling hi -> (query_id, vec_id, score), the k best of each qn, so many times."""
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> Iterator[tuple]:
            now, top, done, own, again = None, [], False, 0, 1
            for b in blocks:
                for qn, query, times, hi, q, v, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if qn != now:
                        yield from ((own, x, -s) for s, x in top for _ in range(again))
                        now, top, done, own, again = qn, [], False, query, times
                    # a vector whose bound equals the k-th score may still come before it by its id
                    if done or len(top) == k and hi < -top[-1][0]:
                        done = True
                        continue
                    score = sum(map(int.__mul__, q, v))
                    if not ENDS[0] <= score <= ENDS[1]:
                        if not saturate:
                            raise OverflowError("a score does not fit 64 bits")
                        score = min(max(score, ENDS[0]), ENDS[1])
                    top += [(-score, x["id"]) for x in ids for _ in range(x["m"]) if x["id"] != query]
                    top = sorted(top if every_row else set(top))[:k]
            yield from ((own, x, -s) for s, x in top for _ in range(again))

        yield from batches(out(), schema)

    return rows.mapInArrow(tidy(run), "query_id long, vec_id long, score long")


def top_k(table: DataFrame, queries: DataFrame, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding", every_row: bool = False, saturate: bool = True) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of floor(scale * x) vectors for every row of queries.

    Every row of table but those with the query's id is a candidate. Rows whose id or vector is null or whose vector has
    a null or non-finite component take no part; vectors are only compared with those of their length. Ties go to the
    smaller id. With every_row each repeated row is a result of its own, and a repeated query row has results of its own, which
    share the ranks of its id; else rows of equal id and score are one result. A query without candidates has no rows.
    With saturate, components beyond 2**62 and scores beyond 64 bits count as that; else they are an error.
    """
    spark = table.sparkSession
    path = work_dir(spark, "va-file")
    write_file(quantised(table, id_col, vector_col, scale, saturate), path, k, every_row)
    asked = quantised(queries, id_col, vector_col, scale, saturate).groupBy("id", "v").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("times"))
    asked = written(asked.select(F.monotonically_increasing_id().alias("qn"), "id", "v", (F.col("times") if every_row else F.lit(1)).alias("times")), "va-queries")
    left = candidates(spark, path, asked.select("qn", "id", "v"), k, every_row)
    exact = spark.read.schema(FILE).parquet(path).select("rid", "v", "ids")
    rows = left.join(exact, "rid").join(asked.select("qn", F.col("id").alias("query_id"), "times", F.col("v").alias("qv")), "qn").select("qn", "query_id", "times", "hi", "qv", "v", "ids")
    arrow_limits(spark, rows=ROWS)
    found = certain_results(rows.repartition("qn").sortWithinPartitions("qn", F.desc("hi")), k, every_row, saturate)
    if not every_row:
        found = found.distinct()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return written(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "va-results")


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, table.where(F.col("vec_id") % 50 == 0), every_row=True, saturate=False)


ORACLE = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), scored as (
  select q.vec_id as query_id, c.vec_id as vec_id,
         cast(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)
), ranked as (
  select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored
)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""
