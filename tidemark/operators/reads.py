"""Reads of a change log: rows (key..., seq, kt, value...) where kt is 1 for a put and 2 for a delete.

Whatever layers the rows come from, the newest version at or below the snapshot decides, and a tombstone decides for
absence. (key, seq) is unique. Filters on key and seq are plain comparisons, so they reach the Parquet scan.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.options import DELETE, PUT
from tidemark.workspace import shared_dir

FIXED = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)


@dataclass(frozen=True)
class ChangeLog:
    """A change log and the names of its columns."""

    df: DataFrame
    key: tuple[str, ...] = ("ukey",)
    seq: str = "seq"
    kind: str = "kt"

    @property
    def values(self) -> list[str]:
        return [c for c in self.df.columns if c not in (*self.key, self.seq, self.kind)]

    def over(self, df: DataFrame) -> ChangeLog:
        return ChangeLog(df, self.key, self.seq, self.kind)

    def visible(self, snapshot: int | Column | None) -> ChangeLog:
        """Rows that a reader at the snapshot may see."""
        return self if snapshot is None else self.over(self.df.where(F.col(self.seq) <= snapshot))

    def newest(self) -> DataFrame:
        """The newest version of each key, tombstones included: one partial aggregate and one shuffle on the key.

        Fixed-width columns are picked one by one, which keeps the hash aggregate; a struct would need a sort.
        """
        picked = [c for c in self.df.columns if c not in (*self.key, self.seq)]
        if all(isinstance(self.df.schema[c].dataType, FIXED) for c in picked):
            aggregates = [F.max_by(c, self.seq).alias(c) for c in picked]
            return self.df.groupBy(*self.key).agg(F.max(self.seq).alias(self.seq), *aggregates).select(*self.df.columns)
        row = self.df.groupBy(*self.key).agg(F.max(F.struct(self.seq, *picked)).alias("_row"))
        return row.select(*self.key, "_row.*").select(*self.df.columns)

    def live(self, snapshot: int | Column | None = None) -> DataFrame:
        """The snapshot scan: key, seq and values of every key that is present."""
        return self.visible(snapshot).newest().where(F.col(self.kind) == PUT).drop(self.kind)

    def get(self, *key, snapshot: int | None = None) -> DataFrame:
        """The value of one key, or no row. The key's equality is pushed to the scan."""
        same = reduce(lambda a, b: a & b, [F.col(c) == F.lit(v) for c, v in zip(self.key, key, strict=True)])
        return self.over(self.df.where(same)).live(snapshot)

    def multi_get(self, keys: DataFrame, snapshot: int | None = None, how: str = "left") -> DataFrame:
        """One row a key of `keys`; with how="left" absent keys have nulls. Only asked keys are aggregated."""
        asked = keys.select(*self.key).distinct()
        found = self.over(self.df.join(asked, list(self.key), "left_semi")).live(snapshot)
        return keys.join(found, list(self.key), how)

    def as_of(self, probes: DataFrame, at: str, parts: int = 64) -> DataFrame:
        """One read a probe row (key, at): the version current at the probe's own snapshot; absent ones have nulls.

        Versions and probes are laid side by side in (key, range of sequence numbers), where a window finds the last
        version before each probe; what a range inherits comes from the last versions of the key's earlier ranges, at
        most `parts` rows a key. Nothing is paired, and a key with very many versions or probes is spread over its ranges.
        """
        edge = self.df.agg(F.min(self.seq).alias("lo"), F.max(self.seq).alias("hi")).first()
        lo, hi = edge["lo"] or 0, edge["hi"] or 0
        width = -(-(hi - lo + 1) // parts)
        place = lambda c: F.least(F.greatest(F.floor((F.col(c) - lo) / width), F.lit(-1)), F.lit(parts)).cast("int")
        row = F.struct(self.seq, self.kind, *self.values)
        versions = self.df.select(*self.key, F.col(self.seq).alias("_t"), place(self.seq).alias("_b"), row.alias("_row"), F.lit(None).cast(probes.schema[at].dataType).alias(at), F.lit(0).alias("_probe"))
        empty = F.lit(None).cast(versions.schema["_row"].dataType).alias("_row")
        asked = probes.select(*self.key, F.col(at).cast("long").alias("_t"), place(at).alias("_b"), empty, at, F.lit(1).alias("_probe"))
        last = F.last("_row", ignorenulls=True)
        inside = Window.partitionBy(*self.key, "_b").orderBy("_t", "_probe").rowsBetween(Window.unboundedPreceding, 0)
        seen = versions.unionByName(asked).withColumn("_in", last.over(inside)).where("_probe = 1").select(*self.key, at, "_b", "_in")
        ends = versions.groupBy(*self.key, "_b").agg(F.max_by("_row", "_t").alias("_row"))
        earlier = Window.partitionBy(*self.key).orderBy("_b", "_probe").rowsBetween(Window.unboundedPreceding, 0)
        # a range's own last version is not before its probes: probes of a range come first here
        marks = ends.select(*self.key, "_b", "_row", F.lit(1).alias("_probe")).unionByName(seen.where("_in is null and _b is not null").select(*self.key, "_b").distinct().select(*self.key, "_b", empty, F.lit(0).alias("_probe")))
        carried = marks.withColumn("_from", last.over(earlier)).where("_probe = 0").select(*self.key, "_b", "_from")
        found = seen.join(carried, [*self.key, "_b"], "left").withColumn("_row", F.coalesce("_in", "_from"))
        there = F.col(f"_row.{self.kind}") == PUT
        return found.select(*self.key, at, *[F.when(there, F.col(f"_row.{c}")).alias(c) for c in (self.seq, *self.values)])

    def find_ge(self, key, snapshot: int | None = None) -> DataFrame:
        """The least live key at or above `key`."""
        return self.seek(key, 1, snapshot)

    def seek(self, key, limit: int, snapshot: int | None = None) -> DataFrame:
        """The first `limit` live keys at or above `key`, in order (forward only)."""
        first = self.key[0]
        return self.over(self.df.where(F.col(first) >= F.lit(key))).live(snapshot).orderBy(*self.key).limit(limit)

    def range(self, low, high, snapshot: int | None = None) -> DataFrame:
        """Live keys in [low, high)."""
        first = F.col(self.key[0])
        return self.over(self.df.where((first >= F.lit(low)) & (first < F.lit(high)))).live(snapshot)

    def prefix(self, start: str, snapshot: int | None = None) -> DataFrame:
        """Live string keys that begin with `start`; startswith is pushed to the scan."""
        return self.over(self.df.where(F.col(self.key[0]).startswith(start))).live(snapshot)

    def keys_only(self, snapshot: int | None = None) -> DataFrame:
        """Live keys without values: value columns are not read."""
        return self.over(self.df.select(*self.key, self.seq, self.kind)).live(snapshot).select(*self.key, self.seq)

    def deleted(self, snapshot: int | None = None) -> DataFrame:
        return self.visible(snapshot).newest().where(F.col(self.kind) == DELETE).select(*self.key, self.seq)


def merged(runs: list[DataFrame], order: list[Column]) -> DataFrame:
    """All rows of several runs in one order; no row is dropped."""
    return reduce(DataFrame.unionByName, runs).orderBy(*order)


def internal_order(key: str = "ukey", seq: str = "seq", kind: str = "kt") -> list[Column]:
    """By key, and the newest version of a key first."""
    return [F.col(key).asc(), F.col(seq).desc(), F.col(kind).desc()]


def layered(layers: list[DataFrame], key: str, seq: str = "seq", kind: str = "kt") -> DataFrame:
    """The first layer that has a key decides, value or tombstone. layers: newest first, each of the same columns.

    Each layer is reduced to its newest version of a key before the layers meet.
    """
    parts = [ChangeLog(layer, (key,), seq, kind).newest().withColumn("_layer", F.lit(i)) for i, layer in enumerate(layers)]
    first = Window.partitionBy(key).orderBy("_layer")
    both = reduce(DataFrame.unionByName, parts)
    return both.withColumn("_n", F.row_number().over(first)).where(f"_n = 1 and {kind} = {PUT}").drop("_n", "_layer", kind)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first k rows: every task keeps k (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def binary_search(values: Column, probe: Column) -> Column:
    """Index of probe in an ascending array, or -(insertion place + 1)."""
    at = F.array_position(values, probe)
    return F.when(at > 0, at - 1).otherwise(-(F.size(F.filter(values, lambda x: x < probe)) + 1)).cast("int")


def assign_sequence(rows: DataFrame, order: list[str], base: int, parts: int | None = None, name: str = "seq") -> DataFrame:
    """rows with base + 1, base + 2, ... in the given order: numbered_rows without the count."""
    return numbered_rows(rows, order, base, parts, name)[0]


def numbered_rows(rows: DataFrame, order: list[str], base: int, parts: int | None = None, name: str = "seq") -> tuple[DataFrame, int]:
    """(rows with a number, how many): base + 1, base + 2, ... in the given order, nulls last; columns of any type that sorts. Rows that are equal in all of
    order follow each other in any order.

    Rows are cut into ranges of the whole order (and, for rows that are equal in it, of the place they were read at), sorted
    and written with their place in their range; what is left is the sum of the counts of earlier ranges, a row a range.
    Without `parts` the number of ranges is the session's, brought down to the size of the data by adaptive execution.
    """
    spark = rows.sparkSession
    inner = [f"c{i}" for i in range(len(rows.columns))]
    at = dict(zip(rows.columns, inner, strict=True))
    keys = [F.col(at[c]).asc_nulls_last() for c in order]
    plain = rows.toDF(*inner).withColumn("read", F.monotonically_increasing_id())
    cut = plain.repartitionByRange(*([parts] if parts else []), *keys, F.col("read").asc()).sortWithinPartitions(*keys, "read")
    place = F.monotonically_increasing_id()
    path = shared_dir(spark, "sequence")
    cut.select(*inner, F.shiftright(place, 33).cast("int").alias("range"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("place")).write.parquet(path)
    done = spark.read.parquet(path)
    counts = done.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()  # a row a range
    before, total = [], 0
    for r in sorted(counts):
        before.append((r["range"], total))
        total += r["n"]
    starts = F.broadcast(spark.createDataFrame(before, "range int, before long"))
    numbered = done.join(starts, "range").select(*inner, (F.lit(base) + F.col("before") + F.col("place") + 1).alias("number"))
    return numbered.select(*[F.col(i).alias(c) for c, i in at.items()], F.col("number").alias(name)), total


def exploded_batch(batches: DataFrame, entries: str, base: str) -> DataFrame:
    """Entry i of a batch gets sequence number base + i. entries: array of structs."""
    other = [c for c in batches.columns if c not in (entries, base)]
    return batches.select(*other, base, F.posexplode(entries).alias("_i", "_e")).select(*other, (F.col(base) + F.col("_i")).alias("seq"), "_e.*")
