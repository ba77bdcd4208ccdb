"""Connected components by iterative joins (alternating large-star and small-star steps)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written


def in_one_task(edges: DataFrame) -> DataFrame:
    """What components gives for edges(a, b) of longs, all read by one task: for as many as one task can hold."""

    def run(blocks: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(k: int) -> int:
            while (above := up.setdefault(k, k)) != k:
                up[k] = k = up[above]
            return k

        for b in blocks:
            for a, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                low, high = sorted((root(a), root(c)))
                up[high] = low
        nodes = list(up)
        for k in range(0, len(nodes), 1 << 16):
            some = nodes[k : k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([root(i) for i in some], pa.int64())], names=["node", "root"])

    return edges.where("a <> b").select("a", "b").coalesce(1).mapInArrow(run, "node long, root long")


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a, b) of any orderable ids -> (node, root): root is the least node of node's component.

    Each step writes its edges to the shared folder. Both stars send a node's neighbours to a smaller centre, so a
    chain of n links is done in about log n steps; the number of links never grows. A centre with very many neighbours
    only takes part in a min aggregate and a join, which partial aggregation and skew splitting handle.
    Nodes without an edge are not in the result.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    digest = None
    for _ in range(100):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # large star: larger neighbours go to the least of the node's neighbourhood
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        # small star: the node and its smaller neighbours go to the least of those
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        now = written(small.where("a <> b").distinct(), name)
        seen = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if seen == digest:
            break
        digest = seen
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)
