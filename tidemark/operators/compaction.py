"""The compaction filter: which versions may go without changing any read at or above the oldest live snapshot."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.reads import ChangeLog
from tidemark.options import DELETE
from tidemark.workspace import shared_dir


def min_live_snapshot(live: list[int], current: int) -> int:
    """The oldest snapshot that a reader holds, or the current sequence number."""
    return min(live) if live else current


def min_live(snapshots: DataFrame, current: int, seq: str = "seq") -> DataFrame:
    return snapshots.agg(F.coalesce(F.min(seq), F.lit(current)).alias("min_seq"))


def drop_shadowed(rows: DataFrame, min_seq: int, key: str = "ukey", seq: str = "seq", kind: str = "kt") -> DataFrame:
    """Drop a version if the next newer one of its key is at or below min_seq: no live reader can see it.

    Said without neighbours: all versions above min_seq stay, and of those at or below it the newest of each key. The first
    part needs no shuffle, the second is a partial aggregate, so a key with very many versions is no single task.
    """
    old = ChangeLog(rows.where(F.col(seq) <= min_seq), (key,), seq, kind).newest()
    return rows.where(F.col(seq) > min_seq).unionByName(old)


def drop_tombstones(rows: DataFrame, min_seq: int, deeper: DataFrame | None = None, key: str = "ukey", seq: str = "seq", kind: str = "kt") -> DataFrame:
    """Drop tombstones at or below min_seq whose key no deeper file may hold. deeper: (min_key, max_key) of those files.

    The ranges come from the manifest, a row a file. Some of their least keys, about the root of their number, cut the key
    space into buckets; a range goes to the buckets that it meets, and only candidate tombstones meet the ranges of their bucket.
    """
    may_go = (F.col(kind) == DELETE) & (F.col(seq) <= min_seq)
    if deeper is None:
        return rows.where(~may_go)
    n, least = deeper.agg(F.count(F.lit(1)), F.min("min_key")).first()
    if not n:
        return rows.where(~may_go)
    every = math.isqrt(n) + 1
    cuts = sorted(r[0] for r in deeper.where(F.pmod(F.xxhash64("min_key"), F.lit(every)) == 0).select("min_key").distinct().collect()) or [least]
    lows = F.array(*[F.lit(c) for c in cuts])
    bucket = lambda c: F.size(F.filter(lows, lambda x: x <= F.col(c)))
    placed = deeper.select("min_key", "max_key", F.explode(F.sequence(bucket("min_key"), bucket("max_key"))).alias("_bucket")).alias("b")
    asked = rows.where(may_go).withColumn("_bucket", bucket(key)).alias("a")
    covered = (F.col("a._bucket") == F.col("b._bucket")) & (F.col(f"a.{key}") >= F.col("b.min_key")) & (F.col(f"a.{key}") <= F.col("b.max_key"))
    return rows.where(~may_go).unionByName(asked.join(placed, covered, "left_semi").drop("_bucket"))


def islands(ranges: DataFrame, low: str, high: str) -> DataFrame:
    """Closed ranges merged where they touch or overlap: island number, least low, greatest high, count.

    Ranges are sorted in range partitions; what reaches into a partition from before it, and how many islands begin
    before it, come from one row a partition.
    """
    spark = ranges.sparkSession
    path = shared_dir(spark, "ranges")
    cut = ranges.select(F.col(low).alias("l"), F.col(high).alias("h")).repartitionByRange("l", "h").sortWithinPartitions("l", "h")
    cut.withColumn("part", F.spark_partition_id()).write.parquet(path)
    done = spark.read.schema(T.StructType([*cut.schema.fields, T.StructField("part", T.IntegerType())])).parquet(path)
    inside = Window.partitionBy("part").orderBy("l", "h")
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    reach = done.groupBy("part").agg(F.max("h").alias("h")).select("part", F.max("h").over(earlier).alias("far"))
    marked = done.join(F.broadcast(reach), "part").withColumn("near", F.max("h").over(inside.rowsBetween(Window.unboundedPreceding, -1)))
    top = F.when(F.col("far").isNull(), F.col("near")).when(F.col("near").isNull(), F.col("far")).otherwise(F.greatest("far", "near"))
    marked = marked.withColumn("new", (top.isNull() | (F.col("l") > top)).cast("int"))
    begun = marked.groupBy("part").agg(F.sum("new").alias("n")).select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begun"))
    numbered = marked.join(F.broadcast(begun), "part").withColumn("island", F.col("begun") + F.sum("new").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("island").agg(F.min("l").alias(low), F.max("h").alias(high), F.count(F.lit(1)).alias("n"))


def compacted(rows: DataFrame, min_seq: int, deeper: DataFrame | None = None, key: str = "ukey", seq: str = "seq", kind: str = "kt") -> DataFrame:
    """Both rules. The input must hold every older version of its keys on its two levels."""
    return drop_tombstones(drop_shadowed(rows, min_seq, key, seq, kind), min_seq, deeper, key, seq, kind)


def empty(spark: SparkSession, schema: str) -> DataFrame:
    """No rows of a schema."""
    return spark.createDataFrame([], schema)
