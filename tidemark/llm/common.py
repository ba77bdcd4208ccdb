"""What the operators of this subpackage share: the work folder, Arrow limits, exact distributed ranks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path under spark.checkpoint.dir; a local folder of our own only where that is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write df to the shared folder and read it again: cuts the lineage and survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def arrow_limits(spark: SparkSession, rows: int = 2048, size: str = "8m") -> None:
    """Batches to Python are bounded by bytes, so a few very long texts do not fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def as_bytes(column: pa.Array | pa.ChunkedArray) -> list[bytes | None]:
    """The UTF-8 bytes of a string column (None for null)."""
    return column.cast(pa.binary()).to_pylist()


def flat_bytes(column: pa.Array) -> tuple[memoryview, list[int]]:
    """The values buffer of a string column and its n + 1 offsets, without a copy per row; null counts as empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    n = len(column)
    starts = memoryview(offsets).cast("q")[column.offset : column.offset + n + 1].tolist() if n else [0]
    return memoryview(data) if data is not None else memoryview(b""), starts


def release() -> None:
    """Give freed memory back to the system at the end of a task: Python workers live on and share an executor's limit."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def tidy(run):
    """A function for mapInArrow that releases memory when its partition is done."""

    def tidied(blocks):
        try:
            yield from run(blocks)
        finally:
            release()

    return tidied


def batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Record batches of at most size rows from tuples."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


HOT_KEYS = 1000


def joined_by(left: DataFrame, right: DataFrame, keys: list[str], refs: str, total: int) -> DataFrame:
    """left and right joined by keys, where right has a row a key and, as refs, how many of left's `total` rows have the key.

    Keys with more than one in HOT_KEYS of all rows are less than HOT_KEYS rows of right: those are broadcast, so such a
    key's rows stay spread as they are. All others are joined by key. right's rows are of fixed width.
    """
    hot = F.col(refs) * HOT_KEYS > total
    few = F.broadcast(right.where(hot))
    rest = left.join(F.broadcast(right.where(hot).select(*keys)), keys, "left_anti")
    return left.join(few, keys).unionByName(rest.join(right.where(~hot), keys))


def positions(df: DataFrame, group: list[str], order: list[Column], name: str, parts: int) -> DataFrame:
    """Add a gapless position from 0 within each group, without one task per group.

    Rows of a group are spread over `parts` buckets by a hash of `order`; a row's position is the rows of the
    group's earlier buckets plus its rank in its own bucket. Only the counts (groups x parts rows) meet in one window.
    """
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    keys = [*group, "_part"]
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    over = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_base"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    on = None
    for k in keys:
        same = ranked[k].eqNullSafe(starts[k])
        on = same if on is None else on & same
    kept = [ranked[c] for c in df.columns if c != "_part"]
    return ranked.join(starts, on).select(*kept, (ranked["_rank"] + starts["_base"]).cast("long").alias(name))
