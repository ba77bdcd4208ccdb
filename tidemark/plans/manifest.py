"""Manifests: version edits, the file set they make, and what to compact next.

As DataFrames, an edit is rows (step, ord, action, level, num, size, min_key, max_key). For planning, a version is a plain list
of File on the driver: it has one entry a file, never one a row of data.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.errors import Corrupted
from tidemark.options import Options

# ---- DataFrame forms


def netted(edits: DataFrame) -> DataFrame:
    """The last action of each (step, level, num): a file added and deleted in one step cancels out.

    A deletion that undoes an addition of its own step leaves nothing; a lone deletion stays.
    """
    w = Window.partitionBy("step", "level", "num").orderBy(F.col("ord").desc())
    last = edits.withColumn("_n", F.row_number().over(w)).withColumn("_added", F.max((F.col("action") == "add").cast("int")).over(Window.partitionBy("step", "level", "num")))
    return last.where((F.col("_n") == 1) & ~((F.col("action") == "del") & (F.col("_added") == 1))).drop("_n", "_added")


def folded(edits: DataFrame, upto: int | None = None) -> DataFrame:
    """Live files after the edits: the last action of each (level, num) is an addition."""
    seen = edits if upto is None else edits.where(F.col("step") <= upto)
    w = Window.partitionBy("level", "num").orderBy(F.col("step").desc(), F.col("ord").desc())
    return seen.withColumn("_n", F.row_number().over(w)).where((F.col("_n") == 1) & (F.col("action") == "add")).drop("_n", "step", "ord", "action")


def scalars(edits: DataFrame, names: list[str]) -> DataFrame:
    """The last known value of each scalar (comparer, sequence number, next file, journal)."""
    return edits.agg(*[F.max_by(F.col(n), F.when(F.col(n).isNotNull(), F.struct("step", "ord"))).alias(n) for n in names])


def delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(action, num): files of one version that the other has not.

    64 numbers that follow each other are one row, a bit a number for either version.
    """
    bit = F.coalesce(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("num").cast("long").bitwiseAND(F.lit(63)).cast("int")), F.lit(1).cast("long"))
    none = F.lit(0).cast("long")
    word = F.shiftright(F.col("num").cast("long"), 6).alias("word")
    both = old.select(word, bit.alias("old"), none.alias("new")).unionByName(new.select(word, none.alias("old"), bit.alias("new")))
    words = both.groupBy("word").agg(F.bit_or("old").alias("old"), F.bit_or("new").alias("new")).where("old <> new")
    each = words.withColumn("i", F.explode(F.array(*map(F.lit, range(64)))))
    was, is_ = (F.call_function("getbit", F.col(c), F.col("i")) == 1 for c in ("old", "new"))
    num = (F.shiftleft("word", 6) + F.col("i")).cast(old.schema["num"].dataType).alias("num")
    return each.where(was != is_).select(F.when(is_, "add").otherwise("del").alias("action"), num)


def orphans(files: DataFrame, versions: DataFrame, pinned: DataFrame) -> DataFrame:
    """Files that no pinned version holds. versions(version, nums array): the reference counts are the exploded rows."""
    held = versions.join(pinned.select("version").distinct(), "version", "left_semi").select(F.explode("nums").alias("num")).distinct()
    return files.join(held, "num", "left_anti")


def reference_counts(versions: DataFrame) -> DataFrame:
    return versions.select(F.explode("nums").alias("num")).groupBy("num").agg(F.count(F.lit(1)).alias("refs"))


def level_stats(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count(F.lit(1)).alias("n_files"), F.sum("size").alias("bytes"))


def level_scores(files: DataFrame, options: Options | None = None) -> DataFrame:
    """(level, score): files over the trigger on level 0, bytes over the level's budget below."""
    o = options or Options()
    budget = F.lit(float(o.level_base)) * F.pow(F.lit(float(o.level_factor)), F.col("level"))
    score = F.when(F.col("level") == 0, F.col("n_files") / F.lit(o.l0_trigger)).otherwise(F.col("bytes") / budget)
    return level_stats(files).select("level", score.alias("score"))


def best_level(scores: DataFrame) -> DataFrame:
    """The level of highest score, the least of equals; compact if it is 1 or more."""
    top = scores.agg(F.max(F.struct("score", (-F.col("level")).alias("neg"))).alias("m"))
    return top.select((-F.col("m.neg")).alias("level"), F.col("m.score").alias("score"), (F.col("m.score") >= 1).alias("needed"))


def overlaps(files: DataFrame, low: Any, high: Any) -> DataFrame:
    """Files whose closed range meets [low, high]."""
    return files.where((F.col("min_key") <= F.lit(high)) & (F.col("max_key") >= F.lit(low)))


def overlap_pairs(files: DataFrame) -> DataFrame:
    """(a, b) with a < b of files whose ranges (of whole numbers) meet, by buckets of the key space.

    Each file goes to the buckets that its range meets, so a pair is only tried where both are; it is reported in the
    bucket of the greater of the two lows.
    """
    edge = files.agg(F.min("min_key").alias("lo"), F.max("max_key").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    lo, hi = edge["lo"] or 0, edge["hi"] or 0
    width = max(1, -(-(hi - lo + 1) // max(1, math.isqrt(edge["n"]))))
    bucket = lambda c: F.floor((F.col(c) - lo) / width).cast("long")
    cut = files.withColumn("first", bucket("min_key")).withColumn("bucket", F.explode(F.sequence(bucket("min_key"), bucket("max_key")))).select("num", "min_key", "max_key", "first", "bucket")
    a, b = cut.alias("a"), cut.alias("b")
    meet = (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.num") < F.col("b.num")) & (F.col("a.min_key") <= F.col("b.max_key")) & (F.col("b.min_key") <= F.col("a.max_key"))
    return a.join(b, meet & (F.col("a.bucket") == F.greatest(F.col("a.first"), F.col("b.first")))).select(F.col("a.num").alias("a"), F.col("b.num").alias("b"))


def candidates(files: DataFrame, key: Any) -> DataFrame:
    """Files that may hold the key: on level 0 all whose range has it, below the first whose greatest key reaches it."""
    reach = files.where(F.col("max_key") >= F.lit(key))
    w = Window.partitionBy("level").orderBy("max_key")
    below = reach.where("level > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return reach.where("level = 0").unionByName(below).where(F.col("min_key") <= F.lit(key))


def first_reaching(files: DataFrame, key: Any) -> DataFrame:
    """Of files in key order, the first whose greatest key is at or above the key."""
    return files.where(F.col("max_key") >= F.lit(key)).orderBy("max_key").limit(1)


# ---- planning on the driver


@dataclass(frozen=True)
class File:
    level: int
    num: int
    size: int
    min_key: Any
    max_key: Any
    rows: int = 0
    min_seq: int = 0
    max_seq: int = 0
    path: str = ""

    def meets(self, low: Any, high: Any) -> bool:
        return self.min_key <= high and self.max_key >= low


@dataclass
class Edit:
    """What one commit changes."""

    add: list[File] = field(default_factory=list)
    delete: list[tuple[int, int]] = field(default_factory=list)  # level, num
    seq: int | None = None
    next_file: int | None = None
    journal: int | None = None
    comparer: str | None = None
    pointers: dict[int, Any] = field(default_factory=dict)

    def net(self) -> Edit:
        """A file that is added and deleted by one edit is in neither list."""
        gone = set(self.delete)
        added = {(f.level, f.num) for f in self.add}
        return Edit([f for f in self.add if (f.level, f.num) not in gone], [d for d in self.delete if d not in added], self.seq, self.next_file, self.journal, self.comparer, self.pointers)


@dataclass
class Version:
    files: list[File] = field(default_factory=list)
    number: int = 0
    seq: int = 0
    next_file: int = 1
    journal: int = 0
    comparer: str = "bytewise"
    pointers: dict[int, Any] = field(default_factory=dict)

    def level(self, n: int) -> list[File]:
        """Level 0 by file number, deeper ones by key."""
        return sorted((f for f in self.files if f.level == n), key=(lambda f: f.num) if n == 0 else (lambda f: (f.min_key, f.num)))

    @property
    def depth(self) -> int:
        """Levels in use; empty ones at the end do not count."""
        return max((f.level for f in self.files), default=-1) + 1

    def apply(self, edit: Edit) -> Version:
        edit = edit.net()
        gone = set(edit.delete) | {(f.level, f.num) for f in edit.add}
        files = [f for f in self.files if (f.level, f.num) not in gone] + edit.add
        return Version(files, self.number + 1, max(self.seq, edit.seq or 0), max(self.next_file, edit.next_file or 0), max(self.journal, edit.journal or 0), edit.comparer or self.comparer, {**self.pointers, **edit.pointers})

    def check(self) -> None:
        """Files of a level below the first are disjoint."""
        for n in range(1, self.depth):
            files = self.level(n)
            for a, b in zip(files, files[1:], strict=False):
                if a.max_key >= b.min_key:
                    raise Corrupted(f"files {a.num} and {b.num} of level {n} overlap")


def hull(files: Iterable[File]) -> tuple[Any, Any]:
    files = list(files)
    return min(f.min_key for f in files), max(f.max_key for f in files)


def closure(files: list[File], seeds: list[File]) -> list[File]:
    """Files that meet the seeds' hull, and the hull of those, until nothing is added."""
    chosen = list(seeds)
    while True:
        low, high = hull(chosen)
        grown = [f for f in files if f.meets(low, high)]
        if len(grown) <= len(chosen):
            return grown
        chosen = grown


def scores(version: Version, options: Options) -> list[float]:
    out = []
    for n in range(version.depth):
        files = version.level(n)
        out.append(len(files) / options.l0_trigger if n == 0 else sum(f.size for f in files) / options.level_budget(n))
    return out


@dataclass
class Compaction:
    level: int
    inputs: list[File]
    below: list[File]
    grandparents: list[File]

    def trivial(self, options: Options) -> bool:
        """One file that meets nothing below and little two below is only moved."""
        return len(self.inputs) == 1 and not self.below and len(self.grandparents) < options.trivial_grandparents

    def moved(self) -> Edit:
        f = self.inputs[0]
        return Edit(add=[File(**{**f.__dict__, "level": f.level + 1})], delete=[(f.level, f.num)], pointers={self.level: f.max_key})


def pick(version: Version, options: Options, score: Callable[[Version, Options], list[float]] = scores) -> Compaction | None:
    """The compaction that is due: the level of highest score if that is 1 or more."""
    s = score(version, options)
    if not s or max(s) < 1:
        return None
    level = s.index(max(s))
    files = version.level(level)
    if level == 0:
        seed = files[0]
    else:
        pointer = version.pointers.get(level)
        seed = next((f for f in files if pointer is None or f.max_key > pointer), files[0])
    return expand(version, level, [seed], options)


def expand(version: Version, level: int, seeds: list[File], options: Options) -> Compaction:
    same, under = version.level(level), version.level(level + 1)
    inputs = closure(same, seeds) if level == 0 else [f for f in same if f.meets(*hull(seeds))]
    below = [f for f in under if f.meets(*hull(inputs))]
    # more of the source level, if that needs no more of the next one and stays within the limit
    both = hull([*inputs, *below])
    grown = closure(same, [f for f in same if f.meets(*both)]) if level == 0 else [f for f in same if f.meets(*both)]
    if len(grown) > len(inputs) and sum(f.size for f in [*grown, *below]) < options.compaction_limit and [f for f in under if f.meets(*hull(grown))] == below:
        inputs = grown
    return Compaction(level, inputs, below, [f for f in version.level(level + 2) if f.meets(*hull([*inputs, *below]))])


def grandparent_cuts(grandparents: list[File], limit: int) -> list[Any]:
    """Keys after which an output is cut, so that none meets much more than `limit` bytes two levels below."""
    cuts, size = [], 0
    for f, after in zip(grandparents, grandparents[1:], strict=False):
        size += f.size
        if size + after.size > limit:
            cuts.append(f.max_key)
            size = 0
    return cuts


def back_pressure(n_level0: int, has_room: bool, options: Options | None = None) -> str:
    """What a writer does: go on, wait a moment once, wait for a compaction, or start a new buffer."""
    o = options or Options()
    if n_level0 >= o.l0_pause and not has_room:
        return "pause"
    if n_level0 >= o.l0_slowdown and n_level0 < o.l0_pause:
        return "slow"
    return "go" if has_room else "rotate"
